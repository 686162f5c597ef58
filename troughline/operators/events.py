"""Cohort and dosing-event tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import add, num, shuffled_join


def time_grid(start, stop, step):
    """SQL text for regular times; an integer sequence is scaled so that times stay exact."""
    count = f"cast(floor(({stop} - {start}) / {step}) as int)"
    return f"transform(sequence(0, {count}), k -> {start} + k * {step})"


def event_grid(cohort, step=C.GRID_STEP, horizon=C.HORIZON):
    """One observation row per patient and grid time."""
    return add(
        add(cohort, time=f"explode({time_grid('0.0D', num(horizon), num(step))})"),
        amt="0.0D", cmt="1", evid="0", rate="0")


def _by_group(values):
    cases = " ".join(f"when CRCL = {num(crcl)} then {num(x)}" for crcl, x in values.items())
    return f"(case {cases} end)"


def loading_dose(loading="standard"):
    """SQL text for the loading dose: one for all, or individual by group."""
    if loading == "standard":
        return num(C.STANDARD_LOADING)
    if loading == "by_group":
        return _by_group(C.LOADING_BY_GROUP)
    raise ValueError(f"unknown loading rule: {loading}")


def schedule(loading="standard", horizon=C.HORIZON):
    """SQL text for the dose array ``[(time, amt)]`` of the patient's group.

    Twice-daily groups are dosed every 12 h; daily groups at 0, 12 and then every 24 h.
    """
    slots = int(horizon // 12)
    daily = " or ".join(f"CRCL = {num(group)}" for group in C.DAILY_GROUPS)
    numbers = f"if({daily}, concat(array(0), sequence(1, {slots}, 2)), sequence(0, {slots}))"
    amount = f"if(k = 0, {loading_dose(loading)}, {_by_group(C.MAINTENANCE_BY_GROUP)})"
    return f"transform({numbers}, k -> named_struct('time', k * 12.0D, 'amt', {amount}))"


def dose_rows(courses, *keep, doses="doses"):
    """Dose events of one-row-per-patient regimens; a held dose stays an event without rate."""
    return add(courses.select(*keep, F.inline(doses)), cmt="1", evid="1", rate="if(amt != 0, -2, 0)")


def upsert_doses(grid, doses):
    """Overwrite amt, evid and rate of the grid rows that have a dose; keep the others.

    A patient's doses meet the grid as one row, amounts by time: a grid that is partitioned by patient is neither
    shuffled nor sorted.
    """
    given = doses.where("ID is not null and time is not null").groupBy("ID").agg(
        F.collect_list(F.struct("time", F.struct("amt").alias("dose"))).alias("_in"))
    amounts = "transform(filter(_in, d -> d.time = t), d -> d.dose)"
    given = add(given, _given=f"map_from_entries(transform(array_distinct(transform(_in, d -> d.time)), t -> struct(t, {amounts})))")
    rows = grid.join(given.select("ID", "_given").hint("shuffle_hash"), "ID", "left")
    rows = rows.select(*grid.columns, F.explode_outer(F.expr("try_element_at(_given, time)")).alias("_dose"))
    hit = F.col("_dose.amt").isNotNull()
    return rows.withColumns({
        "evid": F.when(hit, F.lit(1)).otherwise(F.col("evid")),
        "rate": F.when(hit & (F.col("_dose.amt") != 0), F.lit(-2)).when(hit, F.lit(0))
        .otherwise(F.col("rate")),
        "amt": F.coalesce("_dose.amt", "amt"),
    }).drop("_dose")


def bind_by_key(left, right, keys=("ID", "time")):
    """Put the columns of two tables side by side, matched by key and not by position.

    The rows of a key are brought together as one union of both tables, the right ones as a list: tables that are both
    partitioned by some of the keys, as grids are by patient, are sorted where they lie and not shuffled.
    """
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    known = " and ".join(f"`{k}` is not null" for k in keys)
    mine = left.where(known).select(*keys, F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    other = right.where(known).select(
        *keys, F.lit(None).alias("_left"), F.struct(F.lit(True).alias("_is"), *payload).alias("_right"))
    both = mine.unionByName(other)
    met = both.withColumn("_all", F.collect_list("_right").over(Window.partitionBy(*keys))).where("_left is not null")
    rest = [c for c in left.columns if c not in keys]
    return met.select("_left", F.explode("_all").alias("_one")).select(
        *[F.col(f"_left.`{c}`") for c in (*keys, *rest)], *[F.col(f"_one.`{c}`") for c in payload])


def attach_covariates(events, cohort):
    """Patient columns on every event; events of unknown patients are left out."""
    return shuffled_join(events, cohort, "ID")


def nest_events(events, *fields, key="ID", block_hours=24.0):
    """One time-ordered list per patient and time block.

    Blocks bound the length of a list by the time resolution, whatever a patient's history.
    """
    return events.withColumn("block", F.floor(F.col("time") / block_hours)).groupBy(
        key, "block").agg(F.array_sort(F.collect_list(F.struct("time", *fields))).alias("data"))


def unnest_events(nested):
    return nested.select(*[c for c in nested.columns if c != "data"], F.inline("data"))


def stack_methods(**tables):
    """Union of policy tables with their name in ``method``; missing columns become null."""
    stacked = None
    for method, df in tables.items():
        tagged = df.withColumn("method", F.lit(method))
        stacked = tagged if stacked is None else stacked.unionByName(
            tagged, allowMissingColumns=True)
    return stacked


def label_methods(df):
    """Add the display label and order of each method and the renal group label.

    A method without a label of its own is shown by its code.
    """
    label, order = F, F
    for code, text, rank in C.METHOD_LABELS:
        label = label.when(F.col("method") == code, F.lit(text))
        order = order.when(F.col("method") == code, F.lit(rank))
    return df.withColumns({
        "methodf": label.otherwise(F.col("method")),
        "sort_order": order,
        "crclf": F.concat(F.lit("GFR - "), F.col("CRCL").cast("int").cast("string"), F.lit(" mL/min")),
    })
