"""As-of lookups, window AUCs and versioned rewrites against plain Python."""

import random

import pytest

from troughline.operators import asof, evaluation, regimen


def plain_as_of(rows, facts, strict):
    out = []
    for key, time, tag in rows:
        known = [(t, f) for k, t, f in facts if None not in (k, t, key, time) and k == key and (t < time or (t == time and not strict))]
        out.append((key, time, tag, max(known)[1] if known else None))
    return sorted(map(str, out))


def plain_next_of(rows, facts, strict):
    out = []
    for key, time, tag in rows:
        known = [(-t, f) for k, t, f in facts if None not in (k, t, key, time) and k == key and (t > time or (t == time and not strict))]
        out.append((key, time, tag, max(known)[1] if known else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, strict):
    rng = random.Random(7)
    # one key holds most rows and one fact far before them; ties, null times and null keys
    def key():
        return rng.choice([1, 1, 1, 1, 2, 3, None])

    def time():
        return rng.choice([None] + [rng.randint(0, 40) / 2.0 + rng.choice([0, 500])] * 8)

    rows = [(key(), time(), k) for k in range(300)] + [(9, 10_000.0, 300), (8, 1.0, 301)]
    facts = [(key(), time(), k % 50) for k in range(80)] + [(9, 3.0, 7), (7, 1.0, 1)]
    left = spark.createDataFrame(rows, "ID long, time double, tag long")
    right = spark.createDataFrame(facts, "ID long, time double, fact long")
    got = asof.as_of(left, right, ["fact"], strict=strict, block_hours=3.0)
    assert got.columns == ["ID", "time", "tag", "fact"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_as_of(rows, facts, strict)
    got = asof.next_of(left, right, ["fact"], strict=strict, block_hours=3.0)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_next_of(rows, facts, strict)


def test_as_of_empty_tables(spark):
    left = spark.createDataFrame([(1, 1.0, 1)], "ID long, time double, tag long")
    right = spark.createDataFrame([(1, 0.5, 4)], "ID long, time double, fact long")
    assert [r.fact for r in asof.as_of(left, right.limit(0), ["fact"]).collect()] == [None]
    assert asof.as_of(left.limit(0), right, ["fact"]).collect() == []


def test_window_auc(spark):
    rng = random.Random(8)
    samples = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([0, 0.5, 7, 30, 31, 200]) + rng.randint(0, 60) / 4.0, k, rng.random() * 20)
               for k in range(200)]
    windows = [(rng.choice([1, 2, 3, 4]), k, b, b + rng.choice([0.0, 1.0, 24.0, 300.0])) for k in range(120)
               for b in [rng.randint(-10, 220) / 2.0]]
    frame = spark.createDataFrame(samples, "ID long, time double, event_id long, DV double")
    spans = spark.createDataFrame(windows, "ID long, window_id long, begin double, end double")
    got = {r.window_id: r.auc for r in evaluation.window_auc(frame, spans, "event_id", block_hours=5.0).collect()}
    assert len(got) == len(windows)
    for key, window, begin, end in windows:
        inside = sorted((t, e, v) for k, t, e, v in samples if k == key and begin <= t <= end)
        if not inside:
            assert got[window] is None
        else:
            want = sum((a[2] + b[2]) * (b[0] - a[0]) / 2 for a, b in zip(inside, inside[1:]))
            assert got[window] == pytest.approx(want, abs=1e-9)


def test_rewrite_versions(spark):
    events = [(i, float(t), 1000.0 if t % 12 == 0 else 0.0, int(t % 12 == 0), -2 if t % 12 == 0 else 0) for i in (1, 2, 3) for t in range(0, 73, 6)]
    decisions = [(1, 24.0, 500.0, 24.0, True), (1, 48.0, 0.0, 12.0, True), (1, 60.0, 900.0, 6.0, False), (2, 12.0, 750.0, 6.0, True)]
    table = spark.createDataFrame(events, "ID long, time double, amt double, evid int, rate int")
    made = spark.createDataFrame(decisions, "ID long, sample_time double, dose_amt double, dose_frq double, changed boolean")
    got = {(r.ID, r.time): (r.amt, r.evid, r.rate) for r in regimen.rewrite_versions(table, made, block_hours=13.0).collect()}
    for i, t, amt, evid, rate in events:
        latest = [x for x in decisions if x[0] == i and x[4] and x[1] <= t]
        if latest:
            _, at, dose, frq, _ = max(latest, key=lambda x: x[1])
            due = (t - at) % frq == 0
            amt, evid, rate = (dose if due else 0.0), int(due), (-2 if due and dose else 0)
        assert got[i, t] == (amt, evid, rate)
