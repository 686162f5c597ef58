import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from troughline import schema
from troughline.functions.map_kernel import fit_all, _Batch
from troughline.functions.model import add, settled
from troughline.operators import (
    draws, dosing, estimation, evaluation, events, exposure, policies, quantiles, regimen, sampling,
)
from troughline.plans import study_queries
from troughline.sources import storage

import plain
from conftest import SMALL
from test_model import patients


def test_guideline_boundaries(spark):
    rows = [(float(c), float(x), float(a), f) for c, x, (a, f) in itertools.product(
        (19.9, 20, 39, 39.5, 40, 59.9, 60, 90, 90.1, 100),
        (-2, 9.99, 10, 14.99, 15, 20, 20.01, 25, 25.01, 30, 30.01),
        ((0, 24.0), (1000, 12.0), (750, 8.0)))]
    frame = spark.createDataFrame(rows, "crcl double, conc double, amt double, frq double")
    out = add(frame, d=policies.guideline_decision("crcl", "conc", "amt", "frq")).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = plain.guideline(r.crcl, r.conc, r.amt, r.frq)
        got = (r.d.dose_amt, r.d.dose_frq) if r.d is not None else (None, None)
        assert got == expected, r
    missing = spark.sql("select cast(null as double) as conc, 75.0D as crcl, 1000.0D as amt, 12.0D as frq")
    assert add(missing, d=policies.guideline_decision("crcl", "conc", "amt", "frq")).first().d is None


def test_proportional_steps(spark):
    aucs = [40, 80, 130, 200, 399.99, 400, 470, 550, 550.01, 700, 799.99, 800, 1500, 4000]
    rows = [(float(x), float(a), float(f)) for x, a, f in itertools.product(
        aucs, (250, 500, 750, 1000, 2000, 2250, 5000), (6, 8, 12, 24))]
    frame = spark.createDataFrame(rows, "auc double, amt double, frq double")
    for r in add(frame, d=policies.proportional_decision("auc", "amt", "frq")).collect():
        assert (r.d.dose_amt, r.d.dose_frq) == plain.proportional(r.auc, r.amt, r.frq), r
    zero = spark.sql("select 0.0D as auc, 1000.0D as amt, 12.0D as frq")
    assert add(zero, d=policies.proportional_decision("auc", "amt", "frq")).first().d.dose_amt is None


def test_exact_quantiles(spark):
    """A hot group, a constant group, few distinct values, a single row, nulls among values and nulls alone."""
    rng = np.random.default_rng(5)
    frame = pd.concat([
        pd.DataFrame({"g": "hot", "v": np.exp(rng.normal(0, 3, 6000))}),
        pd.DataFrame({"g": "ties", "v": rng.choice([1.0, 2.0, 7.5], 2000, p=[0.9, 0.05, 0.05])}),
        pd.DataFrame({"g": "same", "v": np.full(1500, 4.25)}),
        pd.DataFrame({"g": "one", "v": [3.0]}),
        pd.DataFrame({"g": [None] * 300, "v": rng.normal(0, 1, 300)}),
    ])
    nulls = pd.DataFrame({"g": ["hot"] * 50 + ["none"] * 7, "v": [None] * 57}, dtype=object)
    probs = quantiles.interval_bounds([0.1, 0.5, 0.9, 0.95]) + [("q0", 0.0), ("med", 0.5), ("q1", 1.0)]
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame(nulls, "g string, v double")).repartition(6)
    out = quantiles.exact_quantiles(df, ["g"], "v", probs).toPandas()
    assert len(out) == 6
    for row in out.to_dict("records"):
        if row["g"] == "none":
            assert all(pd.isna(row[name]) for name, _ in probs)
            continue
        mask = frame.g.isna() if row["g"] is None or row["g"] != row["g"] else frame.g == row["g"]
        for name, p in probs:
            assert row[name] == pytest.approx(np.quantile(frame.v[mask], p), rel=1e-12, abs=1e-12), (row["g"], name)


def skewed_events(spark):
    rng = np.random.default_rng(9)
    hot = np.round(rng.uniform(0, 2000, 1500), 2)
    rest = [(i, float(t)) for i in range(2, 40) for t in np.round(rng.uniform(0, 900, 8), 2)]
    rows = [(1, float(t)) for t in hot] + rest + [(50, 3.0)]
    frame = pd.DataFrame(rows, columns=["ID", "time"]).drop_duplicates().reset_index(drop=True)
    frame["DV"] = np.round(rng.uniform(0, 30, len(frame)), 3)
    frame["eid"] = range(len(frame))
    return frame, spark.createDataFrame(frame).repartition(5)


def test_next_time_and_intervals(spark):
    frame, df = skewed_events(spark)
    truth = frame.sort_values(["ID", "time"]).assign(nxt=lambda d: d.groupby("ID").time.shift(-1))
    out = sampling.with_next_time(df, tie="eid").toPandas().sort_values(["ID", "time"])
    np.testing.assert_array_equal(out.next_time.values, truth.nxt.values)
    gaps = truth.assign(gap=truth.nxt - truth.time).dropna().groupby("ID").gap
    got = sampling.dose_intervals(df, tie="eid").toPandas().set_index("ID").sort_index()
    np.testing.assert_array_equal(got.min_gap.values, gaps.min().values)
    np.testing.assert_array_equal(got.n_gaps.values, gaps.nunique().values)


def test_trapezoid_nth_and_last(spark):
    frame, df = skewed_events(spark)
    ties = spark.createDataFrame([(1, 1.0, 3.0, 1), (1, 1.0, 5.0, 2), (1, 2.0, 1.0, 3)], "ID long, time double, DV double, eid long")
    for turn in (ties, ties.orderBy(F.desc("eid"))):
        assert evaluation.trapezoid_auc(turn, 0.0, 9.0, "eid").first().auc24 == 3.0
    got = evaluation.trapezoid_auc(df, 10.0, 700.0, "eid").toPandas().set_index("ID").auc24
    for i, part in frame[frame.time.between(10, 700)].sort_values("time").groupby("ID"):
        assert got[i] == pytest.approx(np.trapezoid(part.DV, part.time), rel=1e-10, abs=1e-12)
    third = sampling.nth_event(df, 3).toPandas().set_index("ID").time
    expected = frame.sort_values("time").groupby("ID").time.nth(2)
    assert sorted(third) == sorted(expected)
    plan = sampling.nth_event(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    last = sampling.last_event(df, "eid").toPandas().set_index("ID").time
    assert (last.sort_index() == frame.groupby("ID").time.max().sort_index()).all()


def test_daily_auc_and_attainment(spark):
    rows = [(i, m, 100.0, 24.0 * d, float(x)) for i, m, series in (
        (1, "a", (0, 400, 800.5, 1501)), (1, "b", (0, 700, 1400.5, 1400.5)), (2, "a", (0, 10, 410, 1110)))
        for d, x in enumerate(series)]
    profile = spark.createDataFrame(rows, "ID bigint, method string, CRCL double, time double, AUC double")
    daily = evaluation.daily_auc(profile, ("ID", "method"))
    got = {(r.ID, r.method, r.day): r.dAUC for r in daily.collect()}
    assert got[(1, "a", 1.0)] == 400 and got[(1, "a", 2.0)] == 400.5 and got[(1, "b", 1.0)] == 700
    share = {(r.method, r.day): r for r in evaluation.target_attainment(daily, ["method", "day"]).collect()}
    first = share[("a", 1.0)]  # 400 and 10: the efficacy limit is strict, the range is closed
    assert (first.gt400, first.gt700, first.gt400lt700) == (0.0, 0.0, 0.5)
    last = share[("a", 3.0)]  # 700.5 and 700
    assert (last.gt400, last.gt700, last.gt400lt700) == (1.0, 0.5, 0.5)
    assert all(r.gt700 <= r.gt400 and r.gt400lt700 <= 1 - r.gt700 for r in share.values())


def test_nest_round_trip(spark):
    frame, df = skewed_events(spark)
    nested = events.nest_events(df, "DV", "eid")
    assert all(x.data == sorted(x.data) for x in nested.collect())
    back = events.unnest_events(nested).select("ID", "time", "DV", "eid").toPandas()
    key = ["ID", "time", "eid"]
    pd.testing.assert_frame_equal(
        back.sort_values(key, ignore_index=True), frame[back.columns].sort_values(key, ignore_index=True))


def test_upsert_rewrite_and_update(spark):
    cohort = spark.createDataFrame([(1, 100.0), (2, 25.0)], "ID bigint, CRCL double")
    courses = add(cohort, doses=events.schedule("by_group"))
    table = events.upsert_doses(events.event_grid(cohort), events.dose_rows(courses, "ID"))
    assert table.count() == 2 * 673
    doses = table.where("evid = 1").toPandas().sort_values(["ID", "time"])
    assert list(doses[doses.ID == 2].time) == [0, 12, 36, 60, 84, 108, 132, 156]
    assert list(doses[doses.ID == 1].amt)[:2] == [3000, 1500] and (doses.rate == -2).all()
    decisions = spark.createDataFrame(
        [(1, 36.0, 0.0, 24.0, True), (2, 36.0, 500.0, 8.0, False)],
        "ID bigint, sample_time double, dose_amt double, dose_frq double, changed boolean")
    after = regimen.rewrite_events(table, decisions)
    assert after.count() == 2 * 673
    held = after.where("ID = 1 and evid = 1 and time >= 36").toPandas().sort_values("time")
    assert list(held.time) == [36, 60, 84, 108, 132, 156]
    assert (held.amt == 0).all() and (held.rate == 0).all()  # held doses stay events
    same = after.where("ID = 2 or time < 36").exceptAll(table.where("ID = 2 or time < 36"))
    assert same.isEmpty()
    updated = regimen.update_amounts(table, 72.0, 1234.0).where("evid = 1 and time >= 72")
    assert updated.select("amt").distinct().collect()[0][0] == 1234.0


def test_mask_and_semi_join(spark):
    events_ = spark.createDataFrame([(1, 0.0, 5.0), (1, 12.0, 6.0), (2, 12.0, 7.0)], "ID bigint, time double, DV double")
    taken = spark.createDataFrame([(1, 12.0), (1, 12.0), (3, 0.0)], "ID bigint, time double")
    masked = {(r.ID, r.time): r.DV for r in sampling.mask_unsampled(events_, taken).collect()}
    assert masked == {(1, 0.0): None, (1, 12.0): 6.0, (2, 12.0): None}
    assert [tuple(r) for r in sampling.sampled(events_, taken).collect()] == [(1, 12.0, 6.0)]


def one_row(spark, crcl, doses, eta=(0.0, 0.0, 0.0), **extra):
    frame = patients(spark, [(1, 75.0, float(crcl), 0, *eta)])
    array = ", ".join(f"named_struct('time', {t}D, 'amt', {a}D)" for t, a in doses)
    return add(frame, doses=f"array({array})", **extra)


@pytest.mark.parametrize("crcl,eta1,start,end,frq", [
    (100, 0.0, 36.0, 108.0, 12.0), (25, -0.5, 36.0, 60.0, 24.0), (100, 1.2, 36.0, 108.0, 12.0),
    (75, 0.4, 132.0, 168.0, 12.0), (50, -1.5, 36.0, 60.0, 12.0), (50, 0.0, 156.0, 168.0, 12.0)])
def test_target_dose(spark, crcl, eta1, start, end, frq):
    doses = [(0.0, 2000.0), (12.0, 1500.0), (24.0, 1500.0)]
    row = one_row(spark, crcl, doses, (eta1, 0.0, 0.0))
    params = plain.parameters(crcl, eta=(eta1, 0, 0))
    for exact in (False, True):
        text = dosing.target_dose("doses", f"{start}D", f"{end}D", f"{frq}D", rounded=not exact)
        got = add(row, x=text).first().x
        assert got == pytest.approx(plain.aimed(doses, params, start, end, frq, exact), rel=1e-9)
        if exact and 0 < got < 5000 and end - 24 >= start:
            count = int((168 - start) // frq)
            plan = doses + [(start + k * frq, got) for k in range(count + 1)]
            auc = plain.exposure(plan, params, end)[1] - plain.exposure(plan, params, end - 24)[1]
            assert auc == pytest.approx(500, rel=1e-6)


def sampled_patients(n, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        crcl = float(rng.choice([100, 75, 50, 25]))
        eta = rng.normal(0, [0.398, 0.816, 0.571])
        doses = [(0.0, 2000.0)] + [(12.0 * k, 1250.0) for k in range(1, 9)]
        params = plain.parameters(crcl, eta=eta)
        samples = [(t, plain.measure(i + 1, doses, params, t)) for t in (36.0, 60.0, 100.0)[: 1 + i % 3]]
        out.append((crcl, doses, samples))
    return out


def columns(people):
    n = len(people)
    return (np.array([p[0] for p in people]), np.full(n, 75.0), np.zeros(n),
            [[d[0] for d in p[1]] for p in people], [[d[1] for d in p[1]] for p in people],
            [[s[0] for s in p[2]] for p in people], [[s[1] for s in p[2]] for p in people])


def test_map_estimate_beats_a_fine_search():
    people = sampled_patients(24)
    cols = columns(people)
    found = fit_all(*cols)
    batch = _Batch(*cols)
    side = np.linspace(-3, 3, 25)
    sds = np.sqrt([0.158404, 0.665856, 0.326041])
    grid = np.stack(np.meshgrid(*[side * s for s in sds], indexing="ij"), -1).reshape(-1, 3)
    for i in range(len(people)):
        part = batch.rows([i])
        best = part.ofv(grid[None])[0].min()
        assert found[i, 3] <= best + 1e-6
        assert found[i, 3] == pytest.approx(part.ofv(found[i][None, None, :3])[0, 0], abs=1e-9)
        around = found[i, :3] + np.random.default_rng(i).normal(0, 1e-3, (50, 3))
        assert (part.ofv(around[None])[0] >= found[i, 3] - 1e-7).all()


def test_grid_and_refined_estimates(spark):
    people = sampled_patients(12)
    rows = [(i, 75.0, p[0], 0, [tuple(d) for d in p[1]], [tuple(s) for s in p[2]], 200.0)
            for i, p in enumerate(people)]
    df = spark.createDataFrame(rows, """ID bigint, WT double, CRCL double, DIAL int,
        doses array<struct<time:double,amt:double>>, samples array<struct<time:double,DV:double>>,
        sample_time double""")
    grid = estimation.with_grid_estimate(df).select("ID", "est.*").toPandas().set_index("ID").sort_index()
    refined = estimation.with_map_estimate(df).select("ID", "est.*").toPandas().set_index("ID").sort_index()
    batch = _Batch(*columns(people))
    names = ["eta1", "eta2", "eta3"]
    np.testing.assert_allclose(batch.ofv(grid[names].values[:, None])[:, 0], grid.ofv, rtol=1e-10)
    np.testing.assert_allclose(batch.ofv(refined[names].values[:, None])[:, 0], refined.ofv, rtol=1e-10)
    assert (refined.ofv <= grid.ofv + 1e-9).all()


def test_draws(spark):
    base = spark.range(1, 20001).withColumnRenamed("id", "ID")
    etas = draws.with_etas(base, 5).toPandas()
    for i, omega in enumerate((0.158404, 0.665856, 0.326041), start=1):
        assert etas[f"ETA{i}"].mean() == pytest.approx(0, abs=0.03)
        assert etas[f"ETA{i}"].var() == pytest.approx(omega, rel=0.05)
    again = draws.with_etas(base.repartition(13), 5).toPandas()
    pd.testing.assert_frame_equal(
        etas.sort_values("ID", ignore_index=True), again.sort_values("ID", ignore_index=True))
    cut = draws.truncated_normal(base, 0.0, 1.0, (2.5, 3.0), 1).toPandas()  # rarely inside: many passes
    assert len(cut) == 20000 and cut.draw.between(2.5, 3.0).all() and cut.ID.is_unique
    logged = draws.truncated_normal(base, 62.0, 40.0, (0.0, 1e9), 2, log=True).toPandas()
    assert logged.draw.mean() == pytest.approx(62, rel=0.03) and logged.draw.std() == pytest.approx(40, rel=0.08)
    pair = draws.truncated_mvn(base, (0.0, 10.0), (1.0, 2.0), ((1, 0.8), (0.8, 1)), (-9, -9), (9, 30), 3).toPandas()
    assert np.corrcoef(pair.x1, pair.x2)[0, 1] == pytest.approx(0.8, abs=0.02)
    assert pair.x2.mean() == pytest.approx(10, abs=0.1) and pair.x2.std() == pytest.approx(2, rel=0.05)
    with pytest.raises(ValueError):
        draws.truncated_normal(base, 0.0, 1.0, (3.0, 3.0), 1)
    with pytest.raises(ValueError):
        draws.truncated_normal(base, 62.0, 40.0, (-5.0, 0.0), 1, log=True)
    with pytest.raises(ValueError):
        draws.truncated_mvn(base, (0.0,), (1.0, 2.0), ((1,),), (0,), (1,), 1)


def test_first_sample_and_waits(spark):
    frame = spark.createDataFrame([(x,) for x in (19.9, 20.0, 39.0, 39.5, 40.0, 100.0)], "CRCL double")
    got = [r.n for r in add(frame, n=sampling.first_dose_number()).collect()]
    assert got == [None, 3, 3, 4, 4, 4]
    early = [r.n for r in add(frame, n=sampling.first_dose_number(early=True)).collect()]
    assert early == [None, 2, 2, 2, 2, 2]


def test_labels_and_stack(spark):
    base = spark.createDataFrame([(1, 25.0)], "ID bigint, CRCL double")
    out = events.label_methods(events.stack_methods(
        auc24=base, sagov=base.drop("CRCL"), baynl=base, bayes=base)).orderBy("sort_order").collect()
    assert [r.method for r in out] == ["sagov", "auc24", "bayes", "baynl"]
    assert [r.methodf for r in out] == ["SA Health Guidelines", "Proportional TDM", "Model-Based TDM",
                                        "Model-Based w/ Loading Dose"]
    assert out[0].crclf is None and out[1].crclf == "GFR - 25 mL/min"


def test_storage(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_dir(spark) == folder
    df = settled(spark.range(5).toDF("ID"), method="if(ID < 3, 'a', 'b')")
    staged = storage.stage(df, "t")
    assert staged.count() == 5 and folder in staged.inputFiles()[0]
    path = str(tmp_path / "profiles")
    storage.write_profiles(df, path)
    one = storage.read_table(spark, path, df.schema).where("method = 'a'")
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(method" in one._jdf.queryExecution().executedPlan().toString()


def test_packed_profiles_come_back_in_little_room(spark, tmp_path):
    """Rows in any order, nulls, a null method, steps beyond 64 bits, and the size of smooth curves."""
    odd = [(2**62 * (-1) ** k if k % 3 else None, None if k % 5 == 0 else k / 7, 1e-300 * k, None if k % 4 == 0 else (k * k % 1000) / 1e6,
            (-1) ** k * 9.007e12, 0.5, (None, "a", "b")[k % 3]) for k in range(12_007)]
    df = spark.createDataFrame(odd, schema.PROFILE)
    digits = {"IPRE": 6, "AUC": 3, "PERI": 4}
    storage.write_profiles(df, f"{tmp_path}/odd", digits)
    names = [f.name for f in schema.PROFILE]
    back = storage.read_profiles(spark, f"{tmp_path}/odd", schema.PROFILE, digits, names)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in schema.PROFILE]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = storage.read_profiles(spark, f"{tmp_path}/odd", schema.PROFILE, digits, ["ID"], ["a"])
    assert one.count() == 4002 and "PartitionFilters: [isnotnull(method" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="cannot be held with 6 digits"):
        storage.write_profiles(df.withColumn("IPRE", F.lit(1e12)), f"{tmp_path}/large", digits)

    rows = study_queries.profile_roundtrip(spark, SMALL)
    files = [f.removeprefix("file:") for f in rows.inputFiles()]
    assert sum(os.path.getsize(f) for f in files) < 4 * rows.count()
