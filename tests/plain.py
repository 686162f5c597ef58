"""Plain Python versions of the model and the policies, one patient at a time, for comparison."""

import math

import numpy as np

from troughline.functions.map_kernel import fit_all


def hours(amt):
    return 1.0 if amt <= 1500 else 2.0 if amt <= 2000 else amt / 1000.0


def parameters(crcl, wt=75.0, dial=0, eta=(0.0, 0.0, 0.0)):
    cl = 4.5 * (crcl / 120) ** 0.8 * 0.7 ** dial * math.exp(eta[0])
    vc = 58.4 * wt / 70 * 0.5 ** dial * math.exp(eta[1])
    return cl, vc, 38.4 * math.exp(eta[2]), 6.5


def runge_kutta(doses, params, stop, h=1 / 512):
    """Fourth-order integration of the differential equations; returns times and (IPRE, PERI, AUC)."""
    cl, vc, vp, q = params
    steps = int(round(stop / h))
    edges = [(t, t + hours(a), a / hours(a)) for t, a in doses if a > 0]

    def slope(y, rate):
        c1, c2 = y[0] / vc, y[1] / vp
        return np.array([rate + c2 * q - c1 * q - c1 * cl, c1 * q - c2 * q, c1])

    y = np.zeros(3)
    out = [y.copy()]
    for i in range(steps):
        middle = (i + 0.5) * h
        rate = sum(r for a, b, r in edges if a <= middle < b)
        k1 = slope(y, rate)
        k2 = slope(y + h / 2 * k1, rate)
        k3 = slope(y + h / 2 * k2, rate)
        k4 = slope(y + h * k3, rate)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        out.append(y.copy())
    out = np.array(out)
    return np.arange(steps + 1) * h, out / np.array([vc, 1, 1])


def exposure(doses, params, t):
    """IPRE and AUC at t as a sum over earlier doses."""
    cl, vc, vp, q = params
    k10, k12, k21 = cl / vc, q / vc, q / vp
    s = k10 + k12 + k21
    a = (s + math.sqrt(s * s - 4 * k10 * k21)) / 2
    b = k10 * k21 / a
    ipre = auc = 0.0
    for t0, amt in doses:
        if t0 >= t or amt <= 0:
            continue
        length = hours(amt)
        u, v = min(t - t0, length), max(t - t0 - length, 0.0)
        for lam, share in ((a, (a - k21) / (a - b)), (b, (k21 - b) / (a - b))):
            x = amt / length / vc * share / lam
            g = (1 - math.exp(-lam * u)) * math.exp(-lam * v)
            ipre += x * g
            auc += x * (u - g / lam)
    return ipre, auc


def noise(patient, t):
    key = patient * 1009 + int(t * 4)
    return ((key * 15485863 + 31) % 2001 - 1000) / 500, ((key * 32452843 + 37) % 2001 - 1000) / 500


def measure(patient, doses, params, t):
    e1, e2 = noise(patient, t)
    return exposure(doses, params, t)[0] * (1 + e1 * 0.227) + e2 * 3.4


def guideline(crcl, conc, amt, frq):
    def keep(other_amt, other_frq):
        return (amt, frq) if amt != 0 else (other_amt, other_frq)
    if conc > 30:
        return 0, 24
    if crcl > 90:
        return ((1000, 6) if conc < 10 else (1250, 8) if conc < 15 else keep(1000, 12)
                if conc <= 20 else (1250, 12) if conc <= 25 else (1000, 12))
    if crcl >= 60:
        return ((1500, 12) if conc < 10 else (1250, 12) if conc < 15 else keep(750, 12)
                if conc <= 20 else (750, 12))
    if crcl >= 40:
        return (1000, 12) if conc < 15 else keep(500, 12) if conc <= 20 else (500, 12)
    if crcl >= 20:
        return (750, 12) if conc < 15 else keep(750, 24) if conc <= 20 else (750, 24)
    return None, None


def up(x):
    return math.ceil(x / 250) * 250


def proportional(auc, amt, frq):
    if 400 <= auc <= 550:
        return amt, frq
    choices = [6, 8, 12, 24]
    dose = up(amt * 400 / auc)
    while not 500 <= dose <= 2000:
        place = choices.index(frq) + (1 if dose < 500 else -1)
        if not 0 <= place < len(choices):
            break
        dose, frq = up(dose * choices[place] / frq), choices[place]
    return dose, frq


def aimed(doses, params, start, end, frq, exact):
    if end - 24 < start:
        return 1000.0

    def window(amt):
        plan = [d for d in doses if d[0] < start]
        t = start
        while t <= 168:
            plan.append((t, amt))
            t += frq
        return exposure(plan, params, end)[1] - exposure(plan, params, end - 24)[1]

    if window(0) >= 500:
        return 0.0
    tried = [k * 250.0 for k in range(1, 21)]
    best = next((d for d in tried if window(d) >= 500), None)
    if best is None:
        return 5000.0
    if not exact:
        return best
    low, high = best - 250, best
    if best <= 2000:  # proportional in the dose at a fixed infusion time
        found = max(best * (500 - window(0)) / (window(best) - window(0)), low)
    else:  # the infusion time rises with the dose
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if window(middle) >= 500 else (middle, high)
        found = high
    return 0.0 if found < 1 else found


def replay(policy, patient, crcl, eta, doses, early=False, gate=True, exact=False, pairs=False):
    """Regimen and number of rounds of one patient."""
    params = parameters(crcl, eta=eta)
    early = early or pairs
    usual = 3 if crcl <= 39 else 4
    number, rounds, samples = (2 if early else usual), 0, []
    while True:
        s, amt = doses[number - 1]
        frq = doses[number][0] - s
        if policy == "guideline":
            dose, every = guideline(crcl, measure(patient, doses, params, s), amt, frq)
            wait = 24 if dose == 0 else 72
        elif policy == "proportional":
            dv = [measure(patient, doses, params, s - 24 + k / 4) for k in range(97)]
            auc = sum((x + y) / 8 for x, y in zip(dv, dv[1:]))
            dose, every = proportional(auc, amt, frq)
            wait = 24 if auc >= 800 else 72
        else:
            times = [s - math.ceil(3 * frq / 4), s] if pairs else [s]
            seen = {x[0] for x in samples}
            samples += [(t, measure(patient, doses, params, t)) for t in times if t >= 0 and t not in seen]
            past = [d for d in doses if d[0] < s and d[1] > 0]
            est = fit_all(np.array([crcl]), np.array([75.0]), np.array([0.0]),
                          [[d[0] for d in past]], [[d[1] for d in past]],
                          [[x[0] for x in samples]], [[x[1] for x in samples]])[0]
            fitted = parameters(crcl, eta=est[:3])
            now = exposure(doses, fitted, s)[1]
            auc = 2 * now if s < 24 else now - exposure(doses, fitted, s - 24)[1]
            first = early and rounds == 0
            wait = 24 if first or auc >= 800 else 72
            every = (24 if crcl <= 39 else 12) if first else 12 if amt == 0 else frq
            if not gate or auc < 400 or auc >= 550 or amt == 0:
                dose = aimed(doses, fitted, s, min(s + wait, 168), every, exact)
            else:
                dose, every = amt, frq
        if (dose, every) != (amt, frq):
            count = int((168 - s) // every)
            doses = [d for d in doses if d[0] < s] + [(s + k * every, dose) for k in range(count + 1)]
        number = usual if early and rounds == 0 else number + int(wait / every)
        rounds += 1
        if number >= len(doses):
            return doses, rounds
