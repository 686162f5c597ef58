"""Steps that are written for size give what the plain form gives."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from troughline import constants as C
from troughline.functions.map_kernel import _Batch, grid_points
from troughline.functions.model import rounded
from troughline.operators import dosing, draws, events, exposure, policies, quantiles, regimen
from troughline.plans import replay, study_queries
from conftest import SMALL
from test_model import patients


def test_rounding_is_sparks(spark):
    rng = random.Random(1)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 123456789012.3456785, 0.1234565, -0.1234565, 2.5e-7,
              -1e-9, 4e-7, 1.0000005, 7.1234564999999995]
    values += [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(3000)]
    values += [round(rng.uniform(-50, 50), 6) + 5e-7 for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (3, 6, 9):
        for r in frame.selectExpr(f"{rounded('x', n)} as mine", f"round(x, {n}) as theirs").collect():
            assert repr(r.mine) == repr(r.theirs)


def shuffles_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "time" in line.split("Exchange", 1)[1].split("]")[0]]


def test_grids_are_not_shuffled_by_time(spark):
    """Doses and decisions meet a grid that is partitioned by patient without a shuffle by (ID, time) or block."""
    grid = study_queries.induction_grid(spark, SMALL)
    assert not shuffles_of(grid) and "SortMergeJoin" not in grid._jdf.queryExecution().executedPlan().toString()
    versions = study_queries.regimen_versions(spark, SMALL)
    assert not shuffles_of(versions) and "_blk" not in versions._jdf.queryExecution().executedPlan().toString()


def test_doses_at_one_time_stay_rows(spark):
    grid = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.0), (None, 0.0)], "ID long, time double").selectExpr(
        "*", "0.0D as amt", "1 as cmt", "0 as evid", "0 as rate")
    doses = spark.createDataFrame([(1, 0.0, 500.0), (1, 0.0, 0.0), (1, None, 9.0), (2, 3.0, 7.0), (2, 0.0, None)], "ID long, time double, amt double")
    got = sorted(events.upsert_doses(grid, doses).select("ID", "time", "amt", "evid", "rate").collect(), key=str)
    want = [(1, 0.0, 500.0, 1, -2), (1, 0.0, 0.0, 1, 0), (1, 1.0, 0.0, 0, 0), (2, 0.0, 0.0, 0, 0), (None, 0.0, 0.0, 0, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_versions_by_list_and_by_block_agree(spark):
    rng = random.Random(2)
    table = study_queries.induction_grid(spark, SMALL).where("ID <= 20").select("ID", "time", "amt", "evid", "rate")
    made = [(rng.randint(1, 22), rng.choice([0.0, 24.0, 24.0, 60.0, 100.5]), 250.0 * rng.randint(0, 8), rng.choice([6.0, 12.0, 24.0]),
             rng.random() < 0.8) for _ in range(60)]
    made = spark.createDataFrame(made, "ID long, sample_time double, dose_amt double, dose_frq double, changed boolean")
    lists, blocks = (regimen.rewrite_versions(table, made, **kw) for kw in ({}, {"block_hours": 24.0}))
    assert lists.exceptAll(blocks).isEmpty() and blocks.exceptAll(lists).isEmpty() and lists.count() == table.count()


def test_walked_predictions_are_sums_over_doses():
    """Samples inside, at the end of and between infusions, doses after the last sample, and vectors far out."""
    doses = [(0.0, 3000.0), (12.0, 1000.0), (13.0, 0.0), (24.0, 1750.0), (25.0, 500.0), (70.0, 1000.0)]
    samples = [30.0, 0.0, 12.5, 13.0, 1.0, 3.0, 25.5, 26.0, 60.0]
    eta = np.concatenate([grid_points(), [[4.6, -4.6, 4.6], [-4.6, 4.6, -4.6]]])
    got = _Batch(np.array([75.0]), np.array([75.0]), np.zeros(1), [[t for t, _ in doses]], [[a for _, a in doses]],
                 [samples], [[1.0] * len(samples)]).predict(eta[None])[0]
    assert np.isfinite(got).all()
    for e, row in list(zip(eta, got))[::25] + list(zip(eta, got))[-2:]:
        cl = C.TVCL * (75 / C.REF_CRCL) ** C.CL_CRCL * math.exp(e[0])
        vc, k21 = C.TVVC * 75 / C.REF_WT * math.exp(e[1]), C.TVQ / C.TVVP * math.exp(-e[2])
        total = cl / vc + C.TVQ / vc + k21
        fast = (total + math.sqrt(total * total - 4 * cl / vc * k21)) / 2
        slow = cl / vc * k21 / fast
        for s, y in zip(samples, row):
            want = 0.0
            for t, amt in doses:
                if amt > 0 and t < s:
                    h = 1.0 if amt <= 1500 else 2.0 if amt <= 2000 else amt / 1000
                    for k, share in ((fast, fast - k21), (slow, k21 - slow)):
                        want += amt / h * share / ((fast - slow) * k * vc) * (1 - math.exp(-k * min(s - t, h))) * math.exp(-k * max(s - t - h, 0))
            assert abs(y - max(want, C.PREDICTION_FLOOR)) <= 1e-9 * max(abs(want), 1)


def test_no_draw_after_the_one_that_passes(spark):
    def draw(attempt):
        late = F.raise_error(F.lit("drawn again")).cast("double")
        return F.struct(F.when(attempt > 2, late).otherwise(F.col("ID") + attempt).alias("x"))

    got = draws._until_inside(spark.range(3).toDF("ID"), draw, lambda d: d["x"] >= 2).collect()
    assert sorted(tuple(r) for r in got) == [(0, 2.0), (1, 2.0), (2, 3.0)]


def test_bound_grids_are_not_shuffled_by_time(spark):
    bound = study_queries.bind_by_key(spark, SMALL)
    assert not shuffles_of(bound) and "SortMergeJoin" not in bound._jdf.queryExecution().executedPlan().toString()


def test_binding_by_key_is_the_join(spark):
    """Repeated keys on both sides, keys of one side alone, null keys, -0.0 and values that are null."""
    left = spark.createDataFrame([(1, 0.0, 5.0), (1, 0.0, 6.0), (1, 1.0, None), (2, 0.0, 7.0), (None, 0.0, 8.0), (3, None, 9.0)],
                                 "ID int, time double, amt double")
    right = spark.createDataFrame([("a", 1, -0.0), ("b", 1, 0.0), (None, 1, 1.0), ("c", 4, 0.0), ("d", None, 0.0), ("e", 3, None)],
                                  "x string, ID long, time double")
    got = events.bind_by_key(left, right)
    assert got.columns == ["ID", "time", "amt", "x"] and dict(got.dtypes)["ID"] == "int"
    want = left.join(right, ["ID", "time"])
    assert want.count() == 5 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_swept_grids_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(exposure, "stage", lambda df, name: 1 / 0)
    plan = study_queries.exposure_profile(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan.split("Window", 1)[1]


def test_only_patients_numbers_are_shuffled_for_profiles(spark):
    for name in ("exposure_profile", "full_profile"):
        plan = study_queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
        exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
        assert exchanges and all("REPARTITION" in plan[i] and plan[i + 1].count(" AS ") == 1 for i in exchanges), name


def test_sweep_by_patient_and_by_block_agree(spark):
    """Times before the origin, a fast exponent, doses after the last observation, patients without doses or observations."""
    rng = random.Random(4)
    people = [(i, 75.0, 90.0, 0, 0.0, -6.0 if i == 2 else 0.1 * i, 0.0) for i in range(1, 8)]
    doses = [(rng.choice([1, 2, 3, 4, 9]), round(rng.uniform(-200, 900), 1), 250.0 * rng.randint(0, 16)) for _ in range(120)]
    obs = [(rng.choice([1, 2, 3, 5, 8]), round(rng.uniform(-300, 700), 1), k) for k in range(300)] + [(4, 10.0, -1), (4, 10.0, -2)]
    obs, doses = spark.createDataFrame(obs, "ID long, time double, key long"), spark.createDataFrame(doses, "ID long, time double, amt double")
    frame = patients(spark, people)
    for block in (168.0, 24.0):
        one, two = (sorted(map(tuple, exposure.exposure_sweep(obs, doses, frame, block_hours=block, by_patient=b).collect()))
                    for b in (True, False))
        assert len(one) == len(two) == obs.where("ID <= 7").count()
        for a, b in zip(one, two):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-12, atol=1e-12)


def test_percentiles_sort_only_the_bins_of_wanted_ranks(spark, monkeypatch):
    """Values of either sign, zeros, infinities, NaN, subnormals, one narrow bin, groups of a null and of -0.0."""
    kept, real = {}, quantiles.stage

    def counting(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(quantiles, "stage", counting)
    rng = np.random.default_rng(8)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), -float("inf"), 1.0, -1.0, 2.0 ** -17]
    groups = {1.5: rng.normal(0, 9, 4000), 2.5: np.array(odd * 3), None: 1000 + rng.uniform(0, 1e-9, 50), 0.0: np.exp(rng.normal(0, 4, 500))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [(-0.0, float(v)) for v in groups[0.0]] + [(1.5, None)] * 9 + [(7.0, None), (8.0, float("nan")), (8.0, 1.0)]
    probs = [("a", 0.0), ("b", 0.05), ("c", 0.5), ("d", 0.95), ("e", 1.0)]
    frame = spark.createDataFrame(rows, "g double, v double").repartition(7)
    got = {r.g: r[1:] for r in quantiles.exact_quantiles(frame, ["g"], "v", probs).collect()}
    assert len(got) == 6 and got[7.0] == (None,) * 5 and math.isnan(got[8.0][4])
    for g, values in groups.items():
        values = np.sort(np.concatenate([values, values]) if g == 0.0 else values)
        for (_, p), x in zip(probs, got[g]):
            at = (len(values) - 1) * p
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            with np.errstate(invalid="ignore"):
                want = low * (1 - (at - int(at))) + high * (at - int(at))
            assert x == want or abs(x - want) <= 1e-12 * abs(want) or math.isnan(x) and math.isnan(want), (g, p)
    assert kept["values"].where("g = 1.5").count() < 1000


def test_replays_work_out_no_states_after_the_sample(spark, monkeypatch):
    """Neither true nor estimated states go on after the sample, and the dose search takes the estimated ones as they are."""
    state = replay.start(study_queries.study.courses(spark, SMALL), early=True)
    now = replay.situation(state.where("active"))
    assert now.where("exists(segs, x -> x.s >= sample_time + 5)").isEmpty() and not now.where("size(segs) > 2").isEmpty()
    calls, real = [], exposure.dose_segments
    monkeypatch.setattr(dosing, "dose_segments", lambda *args: calls.append(args) or real(*args))
    step = replay.bayes_step(state.where("active"), early=True, estimate="grid")
    assert not calls
    monkeypatch.undo()
    fresh = dosing.target_dose("doses", "sample_time", "next_time", "frq", "e_")
    same = step.selectExpr("d.dose_amt as a", f"if({policies.outside_target('auc24', 'last_amt')}, {fresh}, last_amt) as b")
    assert same.where("not (a <=> b)").isEmpty() and same.count() > 100
    whole = step.selectExpr("auc24 as a", f"{exposure.predict_at(exposure.dose_segments('doses', 'e_'), 'sample_time', 'e_')}.AUC as b")
    assert whole.where("abs(a - 2 * b) > 0").isEmpty()  # first samples of early replays are taken before 24 h
