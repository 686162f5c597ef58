"""Walks over units of long histories under many parameter vectors at once.

Runs inside Arrow batches and uses numpy only. Units of like length are padded to one block, so that a step of the walk
is one operation on all units of the block and all their vectors. Rows of a unit are in time order.
"""

import math

import numpy as np

from .. import constants as C

CELLS = 1 << 14  # units x vectors of a block at most: its arrays stay in a core's cache
HALF_LOG = 0.5 * math.log(2 * math.pi)
OMEGA = np.array(C.OMEGA)


def prior(eta):
    """Negative log prior, the effects on the last axis."""
    return (0.5 * np.log(2 * np.pi * OMEGA) + eta * eta / (2 * OMEGA)).sum(-1)


def padded(lists, fill):
    """Lists as one array; ``fill`` is a number or one for each list."""
    sizes = np.array([len(x) for x in lists])
    out = np.empty((len(lists), max(sizes.max(), 1)))
    out[:] = np.reshape(fill, (-1, 1))
    if sizes.any():
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([x for x in lists if len(x)])
    return out


def blocks(lists, width):
    """Positions of the units of each block."""
    order = np.argsort([len(x) for x in lists], kind="stable")
    size = max(1, CELLS // max(width, 1))
    return [order[i: i + size] for i in range(0, len(order), size)]


def taken(column, at):
    return [column[i] for i in at]


class Rates:
    """Constants of units by vectors; ``eta`` is (vectors, 3) or (units, vectors, 3)."""

    def __init__(self, covcl, covvc, eta):
        cl, vc = covcl[:, None] * np.exp(eta[..., 0]), covvc[:, None] * np.exp(eta[..., 1])
        k10, k21 = cl / vc, C.TVQ / C.TVVP * np.exp(-eta[..., 2])
        total = k10 + C.TVQ / vc + k21
        self.ka = (total + np.sqrt(total * total - 4 * k10 * k21)) / 2
        self.kb = k10 * k21 / self.ka
        self.wa = (self.ka - k21) / ((self.ka - self.kb) * self.ka * vc)
        self.wb = (k21 - self.kb) / ((self.ka - self.kb) * self.kb * vc)


class Block:
    """Rows of a block of units: a row that is no sample has NaN in ``seen``."""

    def __init__(self, begins, time, dr, seen):
        begins = np.asarray(begins, dtype=float)
        last = [x[-1] if len(x) else t for x, t in zip(time, begins)]
        times = padded(time, last)
        self.gaps = np.diff(np.concatenate([begins[:, None], times], axis=1), axis=1)
        self.dr, self.seen = padded(dr, 0.0), padded(seen, np.nan)

    def rows(self, keep):
        part = object.__new__(Block)
        for name, value in vars(self).items():
            setattr(part, name, value[keep])
        return part

    def walk(self, k, rate=None, first=None, at_sample=None):
        """Misfit of units by vectors, from a first ``rate`` and first states (a, b), or from rest.

        ``at_sample(units, misfit, mean)`` is called at every step with the units that have a sample there, what their
        samples before it sum to, and its prediction. ``a`` and ``b`` are kept as what they exceed the steady state by.
        """
        shape = k.ka.shape
        r = np.zeros(shape[0]) if rate is None else np.array(rate, dtype=float)
        a, b = (np.zeros(shape), np.zeros(shape)) if first is None else (
            first[0] - k.wa * r[:, None], first[1] - k.wb * r[:, None])
        steady, misfit = k.wa + k.wb, np.zeros(shape)
        whole, is_sample = slice(None), ~np.isnan(self.seen)
        for step in range(self.gaps.shape[1]):
            gap = self.gaps[:, step]
            if gap.any():
                a *= np.exp(k.ka * -gap[:, None])
                b *= np.exp(k.kb * -gap[:, None])
            here = is_sample[:, step]
            if here.any():
                units = whole if here.all() else np.nonzero(here)[0]
                mean = a[units] + b[units] + steady[units] * r[units, None]
                if at_sample:
                    at_sample(units, misfit[units], mean)
                mean = np.maximum(mean, C.PREDICTION_FLOOR)
                variance = mean * mean * C.ERR_PRO ** 2 + C.ERR_ADD ** 2
                miss = self.seen[units, step, None] - mean
                misfit[units] += HALF_LOG + 0.5 * np.log(variance) + miss * miss / (2 * variance)
            change = self.dr[:, step]
            if change.any():
                a -= k.wa * change[:, None]
                b -= k.wb * change[:, None]
                r = r + change
        return misfit


def first_states(rate, states, size):
    """First rates and states of units of which some, with null, begin at rest."""
    if all(x is None for x in states[0]):
        return None, None
    rest = np.zeros(size)
    return (np.array([0.0 if x is None else r for r, x in zip(rate, states[0])]),
            [np.stack([rest if x is None else x for x in side]) for side in states])


def misfits(covcl, covvc, begins, rate, time, dr, seen, a, b, eta):
    """Misfit of each unit under its vectors; ``eta`` is (vectors, 3), or three columns of lists."""
    found, own = [None] * len(begins), isinstance(eta, tuple)
    for at in blocks(time, max(map(len, eta[0]), default=1) if own else len(eta)):
        vectors = np.stack([padded(taken(e, at), 0.0) for e in eta], -1) if own else eta
        sides = [[x if x is None else np.pad(x, (0, vectors.shape[-2] - len(x))) for x in taken(side, at)] for side in (a, b)]
        block = Block(begins[at], taken(time, at), taken(dr, at), taken(seen, at))
        m = block.walk(Rates(covcl[at], covvc[at], vectors), *first_states(rate[at], sides, vectors.shape[-2]))
        for i, row in zip(at, m):
            found[i] = row[: len(eta[0][i])] if own else row
    return found


def running(covcl, covvc, begins, rate, time, dr, seen, a, b, before, eta):
    """For each unit the best of the vectors before each of its samples and after them, and each prediction under it.

    ``before`` is what the samples of earlier units sum to by vector, or null.
    """
    best, predicted = [None] * len(begins), [None] * len(begins)
    priors = prior(eta)
    for at in blocks(time, len(eta)):
        block = Block(begins[at], taken(time, at), taken(dr, at), taken(seen, at))
        base = np.stack([priors if before[i] is None else priors + before[i] for i in at])
        picks, means = [[] for _ in at], [[] for _ in at]
        everyone = np.arange(len(at))

        def at_sample(units, misfit, mean):
            pick = (base[units] + misfit).argmin(1)
            for i, c, y in zip(everyone[units], pick, mean[np.arange(len(pick)), pick]):
                picks[i].append(c)
                means[i].append(y)

        last = block.walk(Rates(covcl[at], covvc[at], eta),
                          *first_states(rate[at], (taken(a, at), taken(b, at)), len(eta)), at_sample)
        for i, some, c, y in zip(at, picks, (base + last).argmin(1), means):
            best[i], predicted[i] = some + [c], y
    return best, predicted


def search(covcl, covvc, begins, time, dr, seen, start, step, scale):
    """Lattice search of each unit from ``start (units, 3)``: best of the 27 points around, or half the step.

    ``scale`` is a lattice step of each effect. Of equal points the middle one is taken, then the first. Returns the
    points and their objective.
    """
    digits = np.stack(np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij"), -1).reshape(-1, 3)
    around = np.concatenate([digits[13:14], digits[:13], digits[14:]])
    found, ofv = np.array(start), np.empty(len(begins))
    for at in blocks(time, len(around)):
        block = Block(begins[at], taken(time, at), taken(dr, at), taken(seen, at))
        steps, open_ = np.full(len(at), step), np.arange(len(at))
        while len(open_):
            points = found[at[open_], None] + around * steps[open_, None, None]
            eta = points * scale
            rates = Rates(covcl[at[open_]], covvc[at[open_]], eta)
            scores = block.rows(open_).walk(rates) + prior(eta)
            pick, row = scores.argmin(1), np.arange(len(open_))
            found[at[open_]], ofv[at[open_]] = points[row, pick], scores[row, pick]
            steps[open_] = np.where(pick == 0, steps[open_] // 2, steps[open_])
            open_ = open_[steps[open_] > 0]
    return found, ofv


STATE = ("a", "b", "va", "vb", "given", "due")


def probed_states(rates, begins, rate, time, dr, amt, hours, cand, probed, states):
    """State of each unit at each of its probes, under the vector that it names: one list a unit for each of ``STATE``.

    ``rates`` are the columns (ka, kb, wa, wb) of lists by vector and ``probed`` the sorted numbers of these vectors.
    ``cand`` is NaN in rows that are no probe, ``amt`` and ``hours`` in rows that are no begin of a dose.
    """
    found = {name: [None] * len(begins) for name in STATE}
    for at in blocks(time, max(map(len, probed), default=1)):
        block = Block(begins[at], taken(time, at), taken(dr, at), taken(cand, at))
        amts, long = padded(taken(amt, at), 0.0), padded(taken(hours, at), 0.0)
        amts, long = np.nan_to_num(amts), np.nan_to_num(long)
        numbers = padded(taken(probed, at), np.inf)
        ka, kb, wa, wb = (padded(taken(x, at), 1.0) for x in rates)
        r = np.array([0.0 if x is None else x for x in taken(rate, at)])
        a, b, va, vb, given, due = (
            padded([np.zeros(0) if x is None else x for x in taken(states[name], at)], 0.0) for name in STATE)
        zero = np.zeros(ka.shape)
        a, b, va, vb = (zero + x for x in (a, b, va, vb))
        given, due = given[:, 0].copy(), due[:, 0].copy()  # the same under every vector
        is_probe = ~np.isnan(block.seen)
        out = {name: np.zeros(block.seen.shape) for name in STATE}
        for step in range(block.gaps.shape[1]):
            gap = block.gaps[:, step]
            if gap.any():
                da, db = np.exp(-ka * gap[:, None]), np.exp(-kb * gap[:, None])
                held = wa * r[:, None], wb * r[:, None]
                a, b = held[0] + (a - held[0]) * da, held[1] + (b - held[1]) * db
                va, vb, given = va * da, vb * db, given + r * gap
            units = np.nonzero(is_probe[:, step])[0]
            if len(units):
                vector = (numbers[units] < block.seen[units, step, None]).sum(1)
                for name, value in zip(STATE, (a, b, va, vb)):
                    out[name][units, step] = value[units, vector]
                out["given"][units, step], out["due"][units, step] = given[units], due[units]
            change, dose = block.dr[:, step], amts[:, step]
            if dose.any():  # seen from its begin, a whole infusion decays like this much at once
                begun, h = np.where(dose > 0, change, 0.0)[:, None], long[:, step, None]
                va, vb = va + wa * begun * (np.exp(ka * h) - 1), vb + wb * begun * (np.exp(kb * h) - 1)
                due = due + dose
            r = r + change
        for name in STATE:
            for i, values, keep in zip(at, out[name], is_probe):
                found[name][i] = values[keep]
    return found
