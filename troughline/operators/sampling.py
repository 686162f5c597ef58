"""When samples are taken and what the regimen looks like at that time.

Functions on one patient row return Spark SQL text; ``doses`` is the time-ordered array
``[(time, amt)]`` and dose numbers start at one.
"""

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import add, num, shuffled_join
from ..sources.storage import staged_path


def first_dose_number(crcl="CRCL", early=False):
    """Dose before which the first sample is taken; null below the lowest supported CRCL."""
    number = "2" if early else f"if({crcl} <= {num(C.EARLY_CRCL)}, 3, 4)"
    return f"if({crcl} >= {num(C.MIN_CRCL)}, {number}, null)"


def dose_time(doses, number):
    return f"try_element_at({doses}, {number}).time"


def dose_amount(doses, number):
    return f"try_element_at({doses}, {number}).amt"


def dose_gap(doses, number):
    """Interval that follows a dose; null after the last one."""
    return f"({dose_time(doses, f'{number} + 1')} - {dose_time(doses, number)})"


def next_wait(held_or_high):
    """Hours until the next sample: short if the condition holds."""
    return f"if({held_or_high}, {num(C.SHORT_WAIT)}, {num(C.LONG_WAIT)})"


def peak_and_trough(sample_time, interval):
    """Array of the two sample times of a round."""
    return f"array({sample_time} - cast(ceil(3 * {interval} / 4) as double), {sample_time})"


def sampled(events, sample_times):
    """Keep the events at a patient's sample times."""
    return shuffled_join(events, sample_times, "ID", "time", how="left_semi")


def mask_unsampled(events, sample_times, value="DV"):
    """Hide the observations that no sample was taken for."""
    marks = sample_times.select("ID", "time").distinct().withColumn("_seen", F.lit(True))
    return shuffled_join(events, marks, "ID", "time", how="left").withColumn(
        value, F.when(F.col("_seen"), F.col(value))).drop("_seen")


def nth_event(events, n, order=("time",), key="ID"):
    """The nth event of every patient.

    The rank bound is visible to the optimizer, so each task passes on only its first ``n``
    events per patient and a long history is never sorted in one place.
    """
    ranked = events.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).where(F.col("_rn") == n).drop("_rn")


def last_event(events, *fields, key="ID"):
    """Fields of the latest event per patient; ties go to the largest fields."""
    latest = events.groupBy(key).agg(F.max(F.struct("time", *fields)).alias("_last"))
    return latest.select(key, "_last.*")


def with_next_time(events, key="ID", tie=None, block_hours=24.0):
    """Add the time of the patient's next event (null after the last).

    Patients are cut into time blocks so that a long history spreads over many tasks. Inside a
    block the next row answers; for a block's last row the answer is the first time of the next
    block that has rows, found from one summary row per block.
    """
    order = ["time"] + ([tie] if tie else [])
    blocked = events.withColumn("_blk", F.floor(F.col("time") / block_hours))
    firsts = blocked.groupBy(key, "_blk").agg(F.min("time").alias("_first"))
    following = firsts.select(
        key, "_blk",
        F.lead("_first").over(Window.partitionBy(key).orderBy("_blk")).alias("_after"))
    inside = Window.partitionBy(key, "_blk").orderBy(*order)
    return shuffled_join(blocked, following, key, "_blk").withColumn(
        "next_time", F.coalesce(F.lead("time").over(inside), F.col("_after"))
    ).drop("_blk", "_after")


def dose_intervals(events, key="ID", tie=None, block_hours=24.0):
    """Number of different gaps between consecutive events, and the smallest and largest."""
    gaps = with_next_time(events, key, tie, block_hours).withColumn(
        "gap", F.col("next_time") - F.col("time")).where("gap is not null")
    return gaps.groupBy(key, "gap").agg(F.count("*").alias("_n")).groupBy(key).agg(
        F.count("*").alias("n_gaps"), F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"), F.sum("_n").alias("n_pairs"))


def split_rejects(patients, tests):
    """Patients that pass all ``tests``, those that do not with their ``reason``, and how many of each.

    ``tests`` maps a reason to SQL text that is true for a patient to be rejected; the first that holds is the reason,
    and a test that is null does not hold. One pass over ``patients`` writes both tables and counts them on the way
    (``n_rows``, ``n_rejected`` and a count for each reason in the order of ``tests``); both tables are read back from
    what was written, so the counts and the rows are of one run.
    """
    spark = patients.sparkSession
    cases = " ".join(f"when {text} then '{reason}'" for reason, text in tests.items())
    marked = add(patients, reason=f"case {cases} end")
    marked = add(marked, _rejected="reason is not null")
    seen = Observation()
    counts = [F.count("*").alias("n_rows"), F.count_if("_rejected").alias("n_rejected"),
              *[F.count_if(F.col("reason") == reason).alias(f"reason_{k}") for k, reason in enumerate(tests)]]
    path = staged_path(spark, "rejects")
    marked.observe(seen, *counts).write.partitionBy("_rejected").parquet(path)
    found = seen.get
    counted = {"n_rows": found["n_rows"], "n_rejected": found["n_rejected"],
               **{reason: found[f"reason_{k}"] for k, reason in enumerate(tests)}}
    both = spark.read.schema(marked.schema).parquet(path)
    passed = both.where("not _rejected").drop("reason", "_rejected")
    return passed, both.where("_rejected").drop("_rejected"), counted
