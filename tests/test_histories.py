"""Long histories cut into units: the scan, the grid and the lattice search against plain Python."""

import math
import random

import numpy as np
import pytest

from troughline import constants as C
from troughline.functions import history_kernel
from troughline.functions.map_kernel import _Batch
from troughline.functions.model import add, with_parameters, with_rate_constants
from troughline.operators import dosing, estimation, histories

SAMPLES, DOSES = "ID long, time double, key long, DV double", "ID long, time double, amt double"


def tables(spark, seed=4):
    """Patient 1 has most rows; 3 has no doses before its samples, 4 one sample, 5 no samples."""
    rng = random.Random(seed)
    doses = [(1, 12.0 * k + rng.random(), rng.choice([0.0, 500.0, 1250.0, 1750.0, 3000.0])) for k in range(60)]
    doses += [(2, 12.0 * k, 1000.0) for k in range(6)] + [(3, 500.0, 750.0), (4, 0.0, 2000.0), (5, 0.0, 1000.0)]
    samples = [(1, rng.random() * 900, 5 + rng.random() * 30) for _ in range(70)]
    samples += [(2, t, 8 + 3 * rng.random()) for t in (12.0, 12.0, 24.0, 71.5)] + [(3, 10.0, 2.0), (3, 20.0, 1.0), (4, 6.0, 14.0)]
    samples = [(i, t, k, y) for k, (i, t, y) in enumerate(samples)]
    cohort = [(i, 75.0, 25.0 * min(i, 4), 0) for i in range(1, 7)]
    return (spark.createDataFrame(cohort, "ID long, WT double, CRCL double, DIAL int"), spark.createDataFrame(doses, DOSES),
            spark.createDataFrame(samples, SAMPLES), doses, samples, cohort)


def batch(doses, samples, patient):
    given = [(t, amt) for i, t, amt in doses if i == patient[0] and amt > 0]
    seen = [(t, y) for i, t, _, y in samples if i == patient[0]]
    return _Batch(np.array([patient[2]]), np.array([75.0]), np.array([0.0]), [[t for t, _ in given]], [[a for _, a in given]],
                  [[t for t, _ in seen]], [[y for _, y in seen]])


@pytest.mark.parametrize("unit_rows,group", [(128, 32), (8, 3), (3, 2)])
def test_misfits_do_not_depend_on_the_cuts(spark, monkeypatch, unit_rows, group):
    monkeypatch.setattr(histories, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(histories, "GROUP", group)
    cohort, given, seen, doses, samples, patients = tables(spark)
    found = {r.ID: r for r in estimation.history_estimate(cohort, given, seen).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    for patient in patients[:4]:
        grid = np.stack(np.meshgrid(*[np.linspace(-3, 3, 7) * math.sqrt(o) for o in C.OMEGA], indexing="ij"), -1).reshape(-1, 3)
        scores = batch(doses, samples, patient).ofv(grid[None])[0]
        row = found[patient[0]]
        assert row.ofv == pytest.approx(scores.min(), rel=1e-9)
        np.testing.assert_allclose((row.eta1, row.eta2, row.eta3), grid[scores.argmin()], atol=1e-12)
        assert row.n_samples == sum(s[0] == patient[0] for s in samples)


def plain_search(objective, start):
    """The lattice search, one patient and one point at a time."""
    size = 2 ** estimation.FINEST
    scale = np.array([math.sqrt(o) for o in C.OMEGA]) / size
    at, step = [round(n * size) for n in start], size // 2
    while step:
        points = [[n + (d - 1) * step for n, d in zip(at, (c // 9, c // 3 % 3, c % 3))] for c in range(27)]
        scores = objective(np.array(points) * scale)
        best = min(range(27), key=lambda c: (scores[c], c != 13, c))
        at, step = (at, step // 2) if best == 13 else (points[best], step)
    return np.array(at) * scale


@pytest.mark.parametrize("unit_rows", [128, 16])
def test_lattice_search(spark, monkeypatch, unit_rows):
    monkeypatch.setattr(histories, "UNIT_ROWS", unit_rows)
    cohort, given, seen, doses, samples, patients = tables(spark)
    grid = {r.ID: r for r in estimation.history_estimate(cohort, given, seen).collect()}
    found = {r.ID: r for r in estimation.history_map(cohort, given, seen).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    for patient in patients[:4]:
        rows, start = batch(doses, samples, patient), grid[patient[0]]
        first = [eta / math.sqrt(o) for eta, o in zip((start.eta1, start.eta2, start.eta3), C.OMEGA)]
        want = plain_search(lambda etas: rows.ofv(etas[None])[0], first)
        row = found[patient[0]]
        np.testing.assert_allclose((row.eta1, row.eta2, row.eta3), want, atol=1e-9)
        assert row.ofv <= start.ofv + 1e-9


def test_no_rows(spark):
    cohort, given, seen, *_ = tables(spark)
    assert estimation.history_estimate(cohort, given, seen.limit(0)).collect() == []
    assert estimation.history_map(cohort, given, seen.limit(0)).collect() == []
    assert len(estimation.history_estimate(cohort, given.limit(0), seen).collect()) == 4


def grid():
    return np.stack(np.meshgrid(*[np.linspace(-3, 3, 7) * math.sqrt(o) for o in C.OMEGA], indexing="ij"), -1).reshape(-1, 3)


@pytest.mark.parametrize("unit_rows,group", [(128, 32), (8, 3)])
def test_estimates_as_the_samples_come_in(spark, monkeypatch, unit_rows, group):
    monkeypatch.setattr(histories, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(histories, "GROUP", group)
    cohort, given, seen, doses, samples, patients = tables(spark)
    rows = {r.key: r for r in estimation.running_estimates(cohort, given, seen).collect()}
    assert len(rows) == len(samples)
    points = grid()
    for patient in patients[:4]:
        mine = sorted((s for s in samples if s[0] == patient[0]), key=lambda s: (s[1], s[2]))
        prior = (0.5 * np.log(2 * np.pi * np.array(C.OMEGA)) + points ** 2 / (2 * np.array(C.OMEGA))).sum(-1)
        for n, (_, _, key, _) in enumerate(mine):
            before = batch(doses, mine[:n], patient).ofv(points[None])[0] if n else prior
            upto = batch(doses, mine[: n + 1], patient)
            row = rows[key]
            assert row.n_before == n
            assert before[row.cand_before] == pytest.approx(before.min(), rel=1e-9)
            scores = upto.ofv(points[None])[0]
            assert scores[row.cand] == pytest.approx(scores.min(), rel=1e-9)
            last = batch(doses, [mine[n]], patient)
            want = last.predict(points[row.cand_before][None, None])[0, 0, 0]
            assert max(row.IPRE, C.PREDICTION_FLOOR) == pytest.approx(want, rel=1e-9, abs=1e-12)


def auc_of(doses, eta, crcl, at):
    """AUC up to ``at`` of doses (time, amt), each summed by itself."""
    cl = C.TVCL * (crcl / C.REF_CRCL) ** C.CL_CRCL * math.exp(eta[0])
    vc, vp = C.TVVC * 75.0 / C.REF_WT * math.exp(eta[1]), C.TVVP * math.exp(eta[2])
    k10, k12, k21 = cl / vc, C.TVQ / vc, C.TVQ / vp
    total = k10 + k12 + k21
    fast = (total + math.sqrt(total * total - 4 * k10 * k21)) / 2
    slow, out = k10 * k21 / fast, 0.0
    for time, amt in doses:
        if amt > 0 and time < at:
            hours = 1.0 if amt <= 1500 else 2.0 if amt <= 2000 else amt / 1000
            on, off = min(at - time, hours), max(at - time - hours, 0.0)
            for e, share in ((fast, fast - k21), (slow, k21 - slow)):
                weight = amt / hours / vc * share / ((fast - slow) * e)
                out += weight * (on - (1 - math.exp(-e * on)) * math.exp(-e * off) / e)
    return out


@pytest.mark.parametrize("unit_rows,group", [(128, 32), (8, 2)])
def test_states_and_what_they_bring(spark, monkeypatch, unit_rows, group):
    monkeypatch.setattr(histories, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(histories, "GROUP", group)
    cohort, given, _, doses, _, patients = tables(spark)
    rng = random.Random(6)
    probes = [(i, rng.choice([-3.0, 0.0, 0.25, 12.5, 100 * rng.random(), 700 * rng.random()]), k, rng.choice([0, 171, 342, 50]), k % 2)
              for k, i in enumerate([1] * 30 + [2] * 10 + [3] * 4 + [6] * 2)]
    frame = spark.createDataFrame(probes, "ID long, time double, key long, cand int, what int")
    rows = {r.key: r for r in estimation.states_under(cohort, given, frame).collect()}
    assert len(rows) == len(probes)
    for i, time, key, cand, what in probes:
        mine, row, eta = [(t, a) for p, t, a in doses if p == i], rows[key], grid()[cand]
        assert (row.ID, row.cand, row.what) == (i, cand, what)
        auc = row.given / row.CL - row.a / row.ka - row.b / row.kb
        assert auc == pytest.approx(auc_of(mine, eta, patients[i - 1][2], time), rel=1e-9, abs=1e-9)
        past = [(t, a) for t, a in mine if t < time]
        later = row.due / row.CL - row.va * math.exp(-row.ka * 24) / row.ka - row.vb * math.exp(-row.kb * 24) / row.kb
        assert later == pytest.approx(auc_of(past, eta, patients[i - 1][2], time + 24), rel=1e-9, abs=1e-9)


def test_exact_dose_reaches_its_target(spark):
    """Above 2000 mg the infusion time rises with the dose; the AUC at the dose that is returned is the target."""
    rows = [(k, need, 24.0 * (k % 3 + 1)) for k, need in enumerate([10.0, 150.0, 400.0, 700.0, 900.0, 1100.0, 1e6, -1.0])]
    eta, crcl = (0.1, -0.2, 0.3), 75.0
    frame = spark.createDataFrame(rows, "ID long, need double, until double")
    cohort = spark.createDataFrame([(75.0, crcl, 0, *eta)], "WT double, CRCL double, DIAL int, e1 double, e2 double, e3 double")
    model = with_rate_constants(with_parameters(cohort, ("e1", "e2", "e3")))
    times = "transform(sequence(0, cast(until / 12 as int) - 1), j -> named_struct('time', j * 12.0D))"
    made = add(frame.join(model), exact=dosing.dose_for("need", times, "until", rounded=False), up=dosing.dose_for("need", times, "until"))
    above = 0
    for r in made.collect():
        given = [(12.0 * j, r.exact) for j in range(int(r.until / 12))]
        if 0 < r.need < 1e6:
            reached = auc_of(given, eta, crcl, r.until) - auc_of(given, eta, crcl, r.until - 24)
            assert reached == pytest.approx(r.need, abs=1e-6)
            assert 0 <= r.up - r.exact < C.DOSE_STEP
            above += r.exact > 2000
        else:
            assert r.exact == (0.0 if r.need <= 0 else C.MAX_DOSE)
    assert above >= 2


@pytest.mark.parametrize("gathered", [16, 2])
def test_searches_in_rows_and_over_units_agree(spark, monkeypatch, gathered):
    """A patient of few units is searched in one row, a longer one round by round over its units."""
    monkeypatch.setattr(histories, "UNIT_ROWS", 16)
    cohort, given, seen, doses, samples, patients = tables(spark, seed=9)
    whole = {r.ID: r for r in estimation.history_map(cohort, given, seen).collect()}
    monkeypatch.setattr(estimation, "GATHERED", gathered)
    cut = {r.ID: r for r in estimation.history_map(cohort, given, seen).collect()}
    assert sorted(cut) == sorted(whole) == [1, 2, 3, 4]
    for i, row in whole.items():
        np.testing.assert_allclose(tuple(cut[i])[:5], tuple(row)[:5], atol=1e-12)
        assert cut[i].ofv == pytest.approx(row.ofv, rel=1e-9)


def test_walks_of_units_of_unequal_length():
    """Units padded to one block score as they do alone, and as many as there are."""
    rng = np.random.default_rng(3)
    sizes, eta = [0, 1, 7, 40, 3], grid()[::50]
    time = [np.sort(rng.random(n) * 200).round(1) for n in sizes]
    dr = [np.where(rng.random(n) < 0.4, rng.choice([500.0, -500.0], n), 0.0) for n in sizes]
    seen = [np.where(rng.random(n) < 0.5, 10 * rng.random(n), np.nan) for n in sizes]
    covcl, covvc, begins, none = np.full(5, 4.0), np.full(5, 50.0), np.zeros(5), [None] * 5
    rate = np.full(5, np.nan)
    every = history_kernel.misfits(covcl, covvc, begins, rate, time, dr, seen, none, none, eta)
    lists = tuple([eta[: i + 1, k] for i in range(5)] for k in range(3))
    some = history_kernel.misfits(covcl, covvc, begins, rate, time, dr, seen, none, none, lists)
    for i in range(5):
        at = slice(i, i + 1)
        alone = history_kernel.misfits(covcl[at], covvc[at], begins[at], rate[at], time[at], dr[at], seen[at], none[at], none[at], eta)
        np.testing.assert_allclose(every[i], alone[0], rtol=1e-12)
        np.testing.assert_allclose(some[i], every[i][: i + 1], rtol=1e-12)
