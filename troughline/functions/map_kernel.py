"""Vectorised search for the posterior mode of a batch of patients.

Runs inside Arrow batches and uses numpy only. The best point of a coarse grid and the
population value are the starting points; Fisher scoring refines both and the lower objective wins.
"""

import math

import numpy as np

from .. import constants as C

GRID_SIDE = 7  # points per random effect, over plus and minus 3 standard deviations
CELLS = 2_000_000  # array cells per slice of a batch
BLOCK = 1 << 14  # patients x candidates that are walked together


def _padded(lists, fill):
    width = max((len(x) for x in lists), default=0)
    out = np.full((len(lists), max(width, 1)), fill)
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


class _Decay:
    """``exp(-k * hours)`` of units by vectors; what the last step computed is kept where its hours are the same.

    Regimens are regular, so most steps compute nothing.
    """

    def __init__(self, k):
        self.k = k
        self.hours, self.value = np.zeros(len(k)), np.ones(k.shape)

    def over(self, hours, which):
        new = which & (hours != self.hours)
        if new.all():
            self.value = np.exp(self.k * -hours[:, None])
        elif new.any():
            self.value[new] = np.exp(self.k[new] * -hours[new, None])
        self.hours = np.where(new, hours, self.hours)
        return self.value


class _Batch:
    """Objective of a batch of patients for several candidate etas each.

    Samples and doses of a patient are rows in time order. An infusion with no sample inside is one row at its end (before a
    sample at that time) with all that it leaves. Any other is a change of rate on and off.
    """

    def __init__(self, crcl, wt, dial, dose_t, dose_amt, samp_t, samp_y):
        amt, begins = _padded(dose_amt, 0.0), _padded(dose_t, np.inf)
        hours = np.where(amt <= 1500, 1.0, np.where(amt <= 2000, 2.0, amt / 1000))
        when = _padded(samp_t, np.inf)
        self.y = _padded(samp_y, np.nan)[:, None, :]
        self.seen = ~np.isnan(self.y)
        last = np.where(np.isinf(when), -np.inf, when).max(1, keepdims=True)
        begins = np.where((begins < last) & (amt > 0), begins, np.inf)
        ends = begins + hours
        inside = ((begins[..., None] < when[:, None]) & (when[:, None] < ends[..., None])).any(-1)
        none, rate, zero = np.zeros(when.shape), amt / hours, np.zeros(amt.shape)
        offs = np.where(inside, ends, np.inf)
        rows = {"time": (np.where(inside, begins, ends), when, offs),
                "change": (np.where(inside, rate, 0.0), none, np.where(inside, -rate, 0.0)),
                "whole": (np.where(inside, 0.0, rate), none, zero), "hours": (hours, none, hours),
                "sample": (zero - 1, np.arange(when.shape[1]) + none, zero - 1)}
        rows = {name: np.concatenate(parts, axis=1) for name, parts in rows.items()}
        order = np.argsort(rows["time"], axis=1, kind="stable")
        count = max(int(np.isfinite(rows["time"]).sum(1).max(initial=0)), 1)
        rows = {name: np.take_along_axis(part, order, axis=1)[:, :count] for name, part in rows.items()}
        there = np.isfinite(rows["time"])
        time = np.where(there, rows["time"], 0.0)
        self.gap = np.where(there, np.diff(np.concatenate([time[:, :1], time], axis=1), axis=1), 0.0)
        self.change, self.whole = np.where(there, rows["change"], 0.0), np.where(there, rows["whole"], 0.0)
        self.hours, self.sample = rows["hours"], np.where(there, rows["sample"], -1).astype(int)
        self.cl = (C.TVCL * (crcl / C.REF_CRCL) ** C.CL_CRCL * C.CL_DIAL ** dial)[:, None]
        self.vc = (C.TVVC * (wt / C.REF_WT) * C.VC_DIAL ** dial)[:, None]

    def rows(self, keep):
        part = object.__new__(_Batch)
        for name, value in vars(self).items():
            setattr(part, name, value[keep])
        return part

    def predict(self, eta):
        """Predictions of patients by candidates by samples."""
        cl, vc = self.cl * np.exp(eta[..., 0]), self.vc * np.exp(eta[..., 1])
        k10, k12 = cl / vc, C.TVQ / vc
        k21 = C.TVQ / (C.TVVP * np.exp(eta[..., 2]))
        total = k10 + k12 + k21
        fast = (total + np.sqrt(total * total - 4 * k10 * k21)) / 2
        slow = k10 * k21 / fast
        parts = []
        for exponent, share in ((fast, fast - k21), (slow, k21 - slow)):
            weight = share / ((fast - slow) * exponent * vc)
            parts.append((weight, _Decay(exponent), _Decay(exponent), np.zeros(weight.shape)))
        steady, rate = parts[0][0] + parts[1][0], np.zeros(len(cl))
        out = np.zeros(cl.shape + (self.y.shape[-1],))
        for step in range(self.gap.shape[1]):
            gap, change, whole = self.gap[:, step], self.change[:, step], self.whole[:, step]
            moves, sample = gap > 0, self.sample[:, step]
            if moves.any():
                for _, decay, _, x in parts:
                    factor = decay.over(gap, moves)
                    np.multiply(x, factor, out=x, where=True if moves.all() else moves[:, None])
            here = np.nonzero(sample >= 0)[0]
            if len(here):
                out[here, :, sample[here]] = (parts[0][3] + parts[1][3] + steady * rate[:, None])[here]
            if change.any():  # x is what exceeds the steady state of the rate
                for weight, _, _, x in parts:
                    x -= weight * change[:, None]
                rate = rate + change
            if whole.any():
                for weight, _, infused, x in parts:
                    x += weight * (1 - infused.over(self.hours[:, step], whole > 0)) * whole[:, None]
        return np.maximum(np.nan_to_num(out, nan=0.0, posinf=0.0), C.PREDICTION_FLOOR)

    def ofv(self, eta, yhat=None):
        yhat = self.predict(eta) if yhat is None else yhat
        var = (yhat * C.ERR_PRO) ** 2 + C.ERR_ADD ** 2
        miss = np.where(self.seen, self.y - yhat, 0.0)
        fit = np.where(self.seen, 0.5 * np.log(2 * np.pi * var) + miss ** 2 / (2 * var), 0.0)
        omega = np.array(C.OMEGA)
        return fit.sum(-1) + (0.5 * np.log(2 * np.pi * omega) + eta ** 2 / (2 * omega)).sum(-1)


def _scoring(batch, eta, rounds=40, tol=1e-10):
    """Fisher scoring with a choice of step lengths; ``eta`` is (patients, 3)."""
    omega, bound = np.array(C.OMEGA), math.log(C.ETA_FACTOR_BOUNDS[1])
    value = batch.ofv(eta[:, None])[:, 0]
    h = 1e-5
    shifts = np.concatenate([np.zeros((1, 3)), h * np.eye(3), -h * np.eye(3)])
    lengths = np.array([1.0, 0.5, 0.25, 0.1, 0.01, 2.0])
    active = np.arange(len(eta))
    for _ in range(rounds):
        if not len(active):
            break
        part, at = batch.rows(active), eta[active]
        pred = part.predict(at[:, None] + shifts)
        f = pred[:, 0]
        slope = np.where(part.seen, (pred[:, 1:4] - pred[:, 4:7]) / (2 * h), 0.0)
        var = (f * C.ERR_PRO) ** 2 + C.ERR_ADD ** 2
        miss = np.where(part.seen[:, 0], part.y[:, 0] - f, 0.0)
        pull = C.ERR_PRO ** 2 * f / var
        grad = (slope * (pull - miss / var - miss ** 2 * pull / var)[:, None]).sum(-1) + at / omega
        info = np.einsum("bis,bjs,bs->bij", slope, slope, 1 / var + 2 * pull ** 2) + np.diag(1 / omega)
        move = -np.linalg.solve(info, grad[..., None])[..., 0]
        tried = np.clip(at[:, None] + lengths[:, None] * move[:, None], -bound, bound)
        scores = part.ofv(tried)
        pick = scores.argmin(1)
        best = scores[np.arange(len(active)), pick]
        better = best < value[active] - tol
        eta[active[better]] = tried[np.arange(len(active)), pick][better]
        value[active[better]] = best[better]
        active = active[better]
    return eta, value


def grid_points():
    """All points of the coarse grid, the last effect running fastest."""
    return np.stack(np.meshgrid(*[np.linspace(-3, 3, GRID_SIDE) * math.sqrt(o) for o in C.OMEGA],
                                indexing="ij"), -1).reshape(-1, 3)


def _grid_best(batch, size):
    """Best grid point of every patient; equal values go to the first point. A block's arrays stay in a core's cache."""
    grid = grid_points()
    found, ofv, block = np.empty((size, 3)), np.empty(size), max(1, BLOCK // len(grid))
    for i in range(0, size, block):
        part = batch.rows(slice(i, i + block))
        scores = part.ofv(np.broadcast_to(grid, (len(part.cl),) + grid.shape))
        best = scores.argmin(1)
        found[i: i + block], ofv[i: i + block] = grid[best], scores[np.arange(len(best)), best]
    return found, ofv


def fit(refine, *columns):
    size = len(columns[0])
    batch = _Batch(*columns)
    eta, ofv = _grid_best(batch, size)
    if not refine:
        return eta, ofv
    fits = [_scoring(batch, s) for s in (eta.copy(), np.zeros((size, 3)))]
    first = (fits[0][1] <= fits[1][1])[:, None]
    return np.where(first, fits[0][0], fits[1][0]), np.minimum(fits[0][1], fits[1][1])


def fit_all(crcl, wt, dial, dose_t, dose_amt, samp_t, samp_y, refine=True):
    """Estimates and objective of any number of patients, in slices of bounded size.

    ``refine=False`` stops at the best point of the coarse grid.
    """
    columns = (crcl, wt, dial, dose_t, dose_amt, samp_t, samp_y)
    if not len(crcl):
        return np.empty((0, 4))
    widest = max(map(len, dose_t)) * max(map(len, samp_t))
    size = max(1, min(CELLS // (GRID_SIDE * max(widest, 1)), BLOCK // GRID_SIDE))
    parts = []
    for i in range(0, len(crcl), size):
        eta, ofv = fit(refine, *[c[i: i + size] for c in columns])
        parts.append(np.column_stack([eta, ofv]))
    return np.concatenate(parts)
