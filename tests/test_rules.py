"""Rules as a table: lookups against the expression form, overlaps, gaps; rejected patients."""

import pytest

from troughline import constants as C
from troughline.functions.model import add
from troughline.operators import policies, sampling

VALUES = "CRCL double, conc double, last_amt double, last_frq double"


def test_lookup_equals_the_expression(spark):
    crcl = [10.0, 19.9, 20.0, 39.0, 39.5, 40.0, 59.99, 60.0, 90.0, 90.1, 150.0, None]
    conc = [-1.0, 9.99, 10.0, 14.99, 15.0, 20.0, 20.01, 25.0, 25.01, 30.0, 30.01, None]
    rows = [(a, b, last, 12.0) for a in crcl for b in conc for last in (0.0, 1250.0)]
    frame = spark.createDataFrame(rows, VALUES)
    table = policies.RuleTable(policies.guideline_rules(spark))
    both = add(table.decide(frame), d=policies.guideline_decision("CRCL", "conc", "last_amt", "last_frq")).collect()
    assert len(both) == len(rows)
    for r in both:
        missing = r.CRCL is None or r.conc is None
        want = (None, None) if missing or r.d is None else (r.d.dose_amt, r.d.dose_frq)
        assert (r.dose_amt, r.dose_frq) == want, r
    # below the lowest renal function only the rule on high concentrations says anything
    assert table.gaps and all("crcl < 20.0" in gap for gap in table.gaps)


def rule(crcl, conc, amt):
    return (*crcl, *conc, amt, 12.0, None, None)


def make(spark, *rules):
    names = [f"{axis}_{part}" for axis in policies.AXES for part in ("lo", "lo_incl", "hi", "hi_incl")]
    names += ["dose_amt", "dose_frq", "keep_amt", "keep_frq"]
    return spark.createDataFrame([dict(zip(names, r)) for r in rules], policies.RULE_SCHEMA)


def test_overlap_is_refused_and_closed_ends_count(spark):
    low, high = (None, True, 10.0, True), (10.0, False, None, True)
    every = (None, True, None, True)
    whole = policies.RuleTable(make(spark, rule(every, low, 1.0), rule(every, high, 2.0)))
    assert whole.gaps == []
    frame = spark.createDataFrame([(50.0, 10.0, 1.0, 1.0), (50.0, 10.5, 1.0, 1.0)], VALUES)
    assert {r.conc: r.dose_amt for r in whole.decide(frame).collect()} == {10.0: 1.0, 10.5: 2.0}
    with pytest.raises(ValueError, match="rules 1 and 2 overlap"):
        policies.RuleTable(make(spark, rule(every, low, 1.0), rule(every, (10.0, True, None, True), 2.0)))
    with pytest.raises(ValueError, match="overlap"):
        policies.RuleTable(make(spark, rule((20.0, True, 40.0, False), low, 1.0), rule((39.0, True, 60.0, True), low, 2.0)))
    holed = policies.RuleTable(make(spark, rule(every, (None, True, 10.0, False), 1.0), rule(every, high, 2.0)))
    assert holed.gaps == ["crcl, 10.0 <= conc <= 10.0"]
    assert [r.dose_amt for r in holed.decide(frame.where("conc = 10")).collect()] == [None]


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(policies, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        policies.RuleTable(policies.guideline_rules(spark))


def test_rejects_in_one_pass(spark, tmp_path):
    rows = [(k, [None, 5.0, 19.9, 20.0, 80.0][k % 5], k % 7) for k in range(100)]
    spark.createDataFrame(rows, "ID long, CRCL double, DIAL int").write.parquet(f"{tmp_path}/patients")
    patients = spark.read.parquet(f"{tmp_path}/patients")
    tests = {"missing": "CRCL is null", "low": f"CRCL < {C.MIN_CRCL}", "dialysis": "DIAL = 3"}
    passed, rejected, counts = sampling.split_rejects(patients, tests)
    reasons = {k: "missing" if c is None else "low" if c < 20 else "dialysis" if d == 3 else None for k, c, d in rows}
    assert {r.ID: r.reason for r in rejected.collect()} == {k: x for k, x in reasons.items() if x}
    assert sorted(r.ID for r in passed.collect()) == [k for k, x in reasons.items() if not x]
    assert passed.columns == patients.columns
    assert counts == {"n_rows": 100, "n_rejected": rejected.count(),
                      **{x: sum(y == x for y in reasons.values()) for x in tests}}
    assert sampling.split_rejects(patients.limit(0), tests)[2] == {"n_rows": 0, "n_rejected": 0, "missing": 0, "low": 0, "dialysis": 0}
