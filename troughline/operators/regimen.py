"""Changing the future of a regimen."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import num
from .asof import as_of


def new_doses(start, amt, interval, horizon=C.HORIZON):
    """SQL text for the doses of ``amt`` from ``start`` to the horizon."""
    count = f"cast(floor(({num(horizon)} - {start}) / {interval}) as int)"
    return (f"transform(sequence(0, {count}), "
            f"j -> named_struct('time', {start} + j * {interval}, 'amt', {amt}))")


def rewritten(doses, start, amt, interval, horizon=C.HORIZON):
    """SQL text for the regimen with every dose from ``start`` on replaced; the past stays."""
    return (f"concat(filter({doses}, d -> d.time < {start}), "
            f"{new_doses(start, amt, interval, horizon)})")


def rewrite_events(events, decisions):
    """Apply decisions ``(ID, sample_time, dose_amt, dose_frq, changed)`` to an event table.

    Dose times are recognised by their distance from the sample time, so the future needs no
    list of times: one pass over the events is enough.
    """
    future = F.coalesce(F.col("changed") & (F.col("time") >= F.col("sample_time")), F.lit(False))
    return _decided(events.join(decisions, "ID", "left").withColumn("_new", future)).select(*events.columns)


def rewrite_versions(events, decisions, block_hours=None):
    """Apply any number of decisions a patient ``(ID, sample_time, dose_amt, dose_frq, changed)`` to an event table.

    Every event follows the latest decision at or before its time that changed the regimen; of two at one time
    the one with the greater dose, then interval. The decisions of a regimen, which are at least a day apart, meet its events
    as one list: events that are partitioned by patient are neither shuffled nor sorted. With ``block_hours`` histories of any
    length are cut into blocks and sorted instead.
    """
    fields = ("sample_time", "dose_amt", "dose_frq")
    changes = decisions.where("changed")
    if block_hours is not None:
        dated = as_of(events, changes.withColumn("time", F.col("sample_time")), fields, strict=False, block_hours=block_hours)
    else:
        lists = changes.where("ID is not null and sample_time is not null").groupBy("ID").agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("_changes"))
        dated = events.join(lists.hint("shuffle_hash"), "ID", "left").withColumn(
            "_last", F.expr("try_element_at(filter(_changes, d -> d.sample_time <= time), -1)"))
        dated = dated.select(*events.columns, *[F.col(f"_last.{name}").alias(name) for name in fields])
    return _decided(dated.withColumn("_new", F.col("sample_time").isNotNull())).select(*events.columns)


def _decided(events):
    """Events with a decision beside them; those marked ``_new`` follow it."""
    on_time = (F.col("time") - F.col("sample_time")) % F.col("dose_frq") == 0
    return events.withColumns({
        "evid": F.when(F.col("_new"), F.when(on_time, 1).otherwise(0)).otherwise(F.col("evid")),
        "amt": F.when(F.col("_new"), F.when(on_time, F.col("dose_amt")).otherwise(0.0))
        .otherwise(F.col("amt")),
        "rate": F.when(F.col("_new"), F.when(on_time & (F.col("dose_amt") != 0), -2).otherwise(0))
        .otherwise(F.col("rate")),
    })


def update_amounts(events, sample_time, amt):
    """Give every dose from ``sample_time`` on the new amount; times stay."""
    hit = (F.col("time") >= sample_time) & (F.col("evid") == 1)
    return events.withColumn("amt", F.when(hit, F.lit(amt)).otherwise(F.col("amt")))
