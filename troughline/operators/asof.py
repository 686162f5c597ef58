"""The latest fact before each row, for tables in which a key may hold any share of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def as_of(rows, facts, fields, key="ID", strict=True, block_hours=24.0):
    """Add to ``rows (key, time, ...)`` the ``fields`` of the key's latest fact by ``time``.

    With ``strict`` a fact at the row's own time does not count yet. Of facts at one time the one with the
    greatest fields, compared in their order, is taken. Rows without a fact, without a time or without a key get
    nulls.

    Rows and facts are one table, cut into time blocks of a key. Inside a block the last fact that is not null
    is carried forward; what earlier blocks leave is carried from one row a block and joined to the block's
    rows. No row is paired with more than one fact, and no task holds all rows of a key.
    """
    names = rows.columns
    side = F.lit(0 if strict else 1)
    mine = rows.withColumns({"_side": side, "_row": F.lit(True)})
    known = facts.where(F.col(key).isNotNull() & F.col("time").isNotNull()).select(
        key, "time", (F.lit(1) - side).alias("_side"), F.lit(False).alias("_row"), F.struct(*fields).alias("_fact"))
    both = mine.unionByName(known, allowMissingColumns=True).withColumn("_blk", F.floor(F.col("time") / block_hours))

    blocks = both.groupBy(key, "_blk").agg(
        F.max(F.when(~F.col("_row"), F.struct("time", "_fact"))).alias("_last"), F.max("_row").alias("_any"))
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    carried = carried.where(F.col("_any") & F.col("_carried").isNotNull()).select(key, "_blk", F.col("_carried._fact").alias("_carried"))

    upto = Window.partitionBy(key, "_blk").orderBy("time", "_side", "_fact").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(upto)).where("_row")
    found = local.join(carried.hint("merge"), [key, "_blk"], "left").withColumn("_fact", F.coalesce("_fact", "_carried"))
    return found.select(*names, *[F.col(f"_fact.{name}").alias(name) for name in fields])


def next_of(rows, facts, fields, key="ID", strict=False, block_hours=24.0):
    """Like ``as_of``, but the earliest fact after each row (with ``strict``: not at its own time)."""
    def turned(df):
        return df.withColumn("time", -F.col("time"))

    return turned(as_of(turned(rows), turned(facts), fields, key, strict, block_hours))
