import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from troughline.functions import body, model
from troughline.operators import events, exposure

import plain

# IPRE and AUC at 0.25, 12, 24, 36, 48 and 168 h for the typical patient of each group.
GOLDEN = {
    100: ((3.914354, 0.492635), (11.594052, 198.210011), (15.728309, 460.930112),
          (18.567511, 765.444017), (20.435487, 1097.807313), (23.956198, 4854.099911)),
    75: ((3.920570, 0.493156), (12.996947, 209.038628), (15.199228, 444.839756),
         (16.987350, 705.271989), (18.265290, 983.951274), (21.306661, 4113.490990)),
    50: ((3.927238, 0.493715), (14.705802, 221.626165), (16.404981, 459.092003),
         (18.018645, 717.427392), (19.282224, 992.970194), (23.338925, 4157.239974)),
    25: ((3.934664, 0.494337), (16.893529, 236.948431), (22.416502, 543.356484),
         (19.096722, 791.198515), (24.814597, 1126.824282), (30.236313, 4584.552055)),
}
TIMES = (0.25, 12.0, 24.0, 36.0, 48.0, 168.0)


def patients(spark, rows):
    frame = spark.createDataFrame(
        rows, "ID bigint, WT double, CRCL double, DIAL int, ETA1 double, ETA2 double, ETA3 double")
    return model.with_rate_constants(model.with_parameters(frame))


def evaluate(spark, text, **values):
    columns = ", ".join(f"{v} as {k}" for k, v in values.items())
    return spark.sql(f"select {text} as x from (select {columns or '1 as one'})").first()["x"]


def test_golden_values(spark):
    rows = [(i, 75.0, float(c), 0, 0.0, 0.0, 0.0) for i, c in enumerate(GOLDEN, start=1)]
    courses = model.add(patients(spark, rows), doses=events.schedule())
    out = exposure.regimen_profile(courses, ["ID", "CRCL"]).where(F.col("time").isin(*TIMES))
    for row in out.collect():
        ipre, auc = GOLDEN[int(row.CRCL)][TIMES.index(row.time)]
        assert row.IPRE == pytest.approx(ipre, abs=1e-6)
        assert row.AUC == pytest.approx(auc, abs=1e-6)


@pytest.mark.parametrize("amt,effective,intended", [
    (0, 1, 1), (1000, 1, 1), (1001, 1, 1.5), (1500, 1, 1.5), (1501, 2, 2), (2000, 2, 2), (2001, 2.001, 2.001)])
def test_infusion_hours(spark, amt, effective, intended):
    assert evaluate(spark, model.infusion_hours("amt"), amt=f"{amt}.0D") == effective
    assert evaluate(spark, model.infusion_hours("amt", True), amt=f"{amt}.0D") == intended


@pytest.mark.parametrize("secr,age,sex,black,expected", [
    (80, 60, 1, 0, 91.892107), (80, 60, 0, 0, 69.035158),
    (150, 40, 1, 1, 57.321578), (60, 30, 0, 1, 136.124429)])
def test_ckd_epi(spark, secr, age, sex, black, expected):
    text = body.ckd_epi("secr", "age", "sex", "black")
    assert evaluate(spark, text, secr=f"{secr}.0D", age=age, sex=sex, black=black) == pytest.approx(
        expected, abs=1e-6)
    text = body.ckd_epi("secr / 88.4D", "age", "sex", "black", "true")
    assert evaluate(spark, text, secr=f"{secr}.0D", age=age, sex=sex, black=black) == pytest.approx(
        expected, abs=1e-6)


def test_body_size(spark):
    assert evaluate(spark, body.bmi("wt", "ht"), wt="75.0D", ht="175.0D") == pytest.approx(24.489796, abs=1e-6)
    assert evaluate(spark, body.bmi("wt", "ht", cm=False), wt="75.0D", ht="1.75D") == pytest.approx(24.489796, abs=1e-6)
    assert evaluate(spark, body.bsa("wt", "ht"), wt="75.0D", ht="175.0D") == pytest.approx(1.903137, abs=1e-6)


def test_clamp_and_error(spark):
    floor = 2.220446049250313e-16
    for text in ("double('nan')", "double('inf')", "double('-inf')", "cast(null as double)", "-1.0D", "0.0D"):
        assert evaluate(spark, model.clamp_prediction("x0"), x0=text) == floor
    assert evaluate(spark, model.clamp_prediction("x0"), x0="2.5D") == 2.5
    assert evaluate(spark, model.error_sd("10.0D")) == pytest.approx(np.hypot(2.27, 3.4))
    assert evaluate(spark, model.error_sd("10.0D", "additive")) == 3.4
    assert evaluate(spark, model.error_sd("10.0D", "proportional")) == pytest.approx(2.27)
    with pytest.raises(ValueError):
        model.error_sd("x", "other")


def random_histories(seed, patients_n, horizon=168.0):
    rng = np.random.default_rng(seed)
    people, doses = [], []
    for i in range(1, patients_n + 1):
        eta = rng.normal(0, [0.398, 0.816, 0.571])
        people.append((i, float(rng.uniform(40, 120)), float(rng.uniform(20, 130)),
                       int(rng.integers(0, 2)), *map(float, eta)))
        times = np.sort(rng.choice(np.arange(0, horizon, 0.5), 14, replace=False))
        doses += [(i, float(t), float(rng.choice([0, 500, 1250, 1750, 2000, 3250, 5000]))) for t in times]
    return people, doses


def test_layouts_agree_with_integration(spark):
    """Array form, sweep and numeric integration; overlapping infusions and held doses included."""
    people, doses = random_histories(7, 6, 96.0)
    frame = patients(spark, people)
    table = spark.createDataFrame(doses, "ID bigint, time double, amt double")
    nested = table.groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("time", "amt"))).alias("doses"))
    by_array = exposure.regimen_profile(frame.join(nested, "ID"), ["ID"]).toPandas()
    obs = events.event_grid(frame.select("ID")).select("ID", "time")
    keyed = by_array.set_index(["ID", "time"]).sort_index()
    for block in (168.0, 24.0, 5.0):
        swept = exposure.exposure_sweep(obs, table, frame, block_hours=block).toPandas()
        swept = swept.set_index(["ID", "time"]).sort_index()
        assert len(swept) == len(keyed) == 673 * 6
        for name in ("IPRE", "AUC", "PERI"):
            np.testing.assert_allclose(swept[name], keyed[name], rtol=1e-9, atol=1e-8)
    for person in people[:3]:
        i, wt, crcl, dial, *eta = person
        own = [(t, a) for p, t, a in doses if p == i]
        times, truth = plain.runge_kutta(own, plain.parameters(crcl, wt, dial, eta), 48)
        mine = keyed.loc[i]
        for t in (3.0, 10.25, 24.0, 48.0):
            at = truth[int(round(t * 512))]
            assert mine.loc[t, "IPRE"] == pytest.approx(at[0], rel=1e-7, abs=1e-9)
            assert mine.loc[t, "PERI"] == pytest.approx(at[1], rel=1e-7, abs=1e-7)
            assert mine.loc[t, "AUC"] == pytest.approx(at[2], rel=1e-7, abs=1e-9)


def test_sweep_hot_patient_and_fast_exponent(spark):
    """One patient holds most rows over years; another has a very fast exponent; a third no doses."""
    rng = np.random.default_rng(3)
    people = [(1, 75.0, 90.0, 0, 0.0, 0.0, 0.0), (2, 75.0, 90.0, 0, 0.0, -6.0, 0.0), (3, 75.0, 90.0, 0, 0.0, 0.0, 0.0),
              (4, 75.0, 90.0, 0, 0.0, 0.0, 0.0)]
    doses = [(1, float(t), 750.0) for t in np.arange(0, 8000, 8.0)] + [(2, float(t), 1000.0) for t in (0, 12, 24)]
    doses += [(4, -350.0, 1000.0), (4, -10.0, 500.0)]  # times may lie before the origin
    obs = [(1, float(t)) for t in np.round(rng.uniform(0, 9000, 3000), 3)]
    obs += [(2, float(t)) for t in (0.5, 1.0, 6.0, 12.5, 30.0)] + [(3, 10.0), (1, -5.0), (4, -300.0), (4, 2.0)]
    out = exposure.exposure_sweep(
        spark.createDataFrame(obs, "ID bigint, time double"),
        spark.createDataFrame(doses, "ID bigint, time double, amt double"), patients(spark, people)).toPandas()
    assert len(out) == len(obs)
    by_id = {i: [(t, a) for p, t, a in doses if p == i] for i in (1, 2, 3, 4)}
    params = {p[0]: plain.parameters(p[2], p[1], p[3], p[4:]) for p in people}
    for row in pd.concat([out[out.ID == 1].sample(40, random_state=1), out[out.ID != 1]]).itertuples():
        ipre, auc = plain.exposure(by_id[row.ID], params[row.ID], row.time)
        assert row.IPRE == pytest.approx(ipre, rel=1e-8, abs=1e-9)
        assert row.AUC == pytest.approx(auc, rel=1e-8, abs=1e-8)


def test_exposure_properties(spark):
    people, doses = random_histories(11, 5)
    frame = patients(spark, people)
    table = spark.createDataFrame(doses, "ID bigint, time double, amt double")
    obs = events.event_grid(frame.select("ID"), step=2.0).select("ID", "time")

    def run(part):
        return exposure.exposure_sweep(obs, part, frame).toPandas().sort_values(["ID", "time"])

    whole, one, two = run(table), run(table.where("time < 60")), run(table.where("time >= 60"))
    np.testing.assert_allclose(one.AUC.values + two.AUC.values, whole.AUC.values, atol=1e-7)
    np.testing.assert_allclose(one.IPRE.values + two.IPRE.values, whole.IPRE.values, atol=1e-8)
    assert (whole.groupby("ID").AUC.diff().dropna() >= -1e-8).all()
