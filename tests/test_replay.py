import pytest
from pyspark.sql import functions as F

from troughline.plans import replay, report
from troughline.sources import study
from troughline.functions.model import add

import plain
from conftest import SMALL

VARIANTS = {
    "base": {},
    "early": {"early": True},
    "noround": {"early": True, "rounded": False},
    "alwaysopt": {"early": True, "rounded": False, "gate": False},
    "peak_trough": {"peak_trough": True, "rounded": False, "gate": False},
}


def compare(spark, final, policy, loading="standard", tolerance=1e-9, **options):
    start = {r.ID: r for r in study.courses(spark, SMALL, loading).collect()}
    etas = {r.ID: (r.ETA1, r.ETA2, r.ETA3) for r in study.cohort(spark, SMALL).collect()}
    rows = final.collect()
    assert len(rows) == len(start) == 150
    assert not any(r.active for r in rows)
    for r in rows:
        first = [(d.time, d.amt) for d in start[r.ID].doses]
        doses, rounds = plain.replay(policy, r.ID, r.CRCL, etas[r.ID], first, **options)
        assert [d.time for d in r.doses] == [d[0] for d in doses], r.ID
        assert [d.amt for d in r.doses] == pytest.approx([d[1] for d in doses], rel=tolerance), r.ID
        assert r.rounds == rounds


def test_guideline(spark):
    compare(spark, replay.replay_simple(study.courses(spark, SMALL), replay.guideline_step), "guideline")


def test_proportional(spark):
    compare(spark, replay.replay_simple(study.courses(spark, SMALL), replay.proportional_step), "proportional")


@pytest.mark.parametrize("name", VARIANTS)
def test_bayes(spark, name):
    options = VARIANTS[name]
    final = replay.replay_bayes(study.courses(spark, SMALL), **options)
    compare(spark, final, "bayes", tolerance=1e-5, early=options.get("early", False),
            gate=options.get("gate", True), exact=not options.get("rounded", True),
            pairs=options.get("peak_trough", False))


def test_individual_loading(spark):
    final = replay.replay_bayes(study.courses(spark, SMALL, "by_group"))
    compare(spark, final, "bayes", "by_group", 1e-5)


def test_rejected_patients_keep_their_regimen(spark):
    courses = study.courses(spark, SMALL).limit(6)
    low = add(courses, CRCL="if(ID % 2 = 0, 15.0D, CRCL)")
    before = {r.ID: r.doses for r in low.collect()}
    for final in (replay.replay_simple(low, replay.guideline_step), replay.replay_bayes(low)):
        rows = final.collect()
        assert len(rows) == 6
        for r in rows:
            assert (r.rounds == 0) == (r.CRCL < 20)
            if r.CRCL < 20:
                assert r.doses == before[r.ID]


def test_unfinished_regimens_are_an_error(spark):
    courses = study.courses(spark, SMALL)
    with pytest.raises(Exception, match="still sampled after 1 rounds"):
        replay.replay_simple(courses, replay.guideline_step, rounds=1).select("doses").collect()
    with pytest.raises(ValueError, match="still sampled after 1 rounds"):
        replay.replay_bayes(courses, rounds=1)


def test_simple_replay_needs_no_extra_shuffle(spark):
    plan = replay.replay_simple(study.courses(spark, SMALL), replay.guideline_step)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text


def test_report_is_complete(spark):
    finals = replay.replay_simple(study.courses(spark, SMALL), replay.guideline_step)
    finals = finals.withColumn("method", F.lit("sagov"))
    table = report.policy_report(
        report.daily_exposure(report.profiles(finals, step=24.0)), report.profiles(finals))
    counts = {r.part: r.n for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert counts == {"pta_method": 7 * 3, "pta_method_group": 7 * 4 * 3, "percentile_profile": 673 * 4 * 3}
