"""Shards of equal mixture by proportional stratified interleaving, in DataFrame operations only.

Rows are put in a seeded random order within their source. The row of rank r among the n of its
source gets the fraction (r - 1/2) / n, so that the rows of every source spread evenly over 0..1.
All rows sorted by that fraction are cut into shards of equal row counts (one row apart at most),
and each stretch of the order holds the mixture of the whole.

Ranks come from range-partitioned sorts: a row's rank is its place in its partition plus the counts
of the partitions before, which are a small table. No source, however large, is ranked in one task.

Defined cases: null text has no bytes; a null source is a source of its own; rows that agree in id
and text are interchangeable and each gets its own place; null ids sort first; no rows give no rows;
extra columns are left out of the assignment.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm.base import stage

#: Bytes that a stored row takes besides its text.
ROW_BYTES = 8
#: Rows of one sorted partition are numbered in the low bits of Spark's increasing id.
_PLACE = (1 << 33) - 1


def _placed(df, order, name):
    """``df`` sorted over all partitions, with its partition ``part`` and place ``at`` in it, stored."""
    mid = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", mid)
    table = ordered.withColumn("part", F.shiftright("mid", 33)).withColumn("at", F.col("mid").bitwiseAND(F.lit(_PLACE)))
    return stage(table.drop("mid"), name)


def interleave(df, shards, seed=0, id_col="doc_id", text_col="text", source_col="source"):
    """Id, size, text_crc32, source, shard (from 0) and slot in the shard (from 0) of every row."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(
        df[id_col].alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        df[source_col].cast("string").alias("source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), df[id_col].cast("string"))).alias("draw"),
    )
    by_source = _placed(rows, ["source", "draw", "doc_id", "text_crc32", "size"], "by-source")
    # the counts before each (source, partition) and of each source: one row for each pair that occurs
    pieces = by_source.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    within = Window.partitionBy("source")
    pieces = pieces.select(
        F.col("source").alias("piece_source"),
        F.col("part").alias("piece_part"),
        "first",
        (F.sum("n").over(within.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(within).alias("of"),
    )
    ranked = by_source.join(
        pieces,
        (F.col("part") == F.col("piece_part")) & F.col("source").eqNullSafe(F.col("piece_source")),
    )
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    fraction = (rank.cast("double") - F.lit(0.5)) / F.col("of").cast("double")
    ranked = ranked.select("doc_id", "size", "text_crc32", "source", "draw", fraction.alias("fraction"))

    by_fraction = _placed(ranked, ["fraction", "source", "draw", "doc_id", "text_crc32", "size"], "by-fraction")
    parts = by_fraction.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a partition of the sort
    parts = parts.select(
        F.col("part").alias("of_part"),
        (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(every).alias("total"),
    )
    placed = by_fraction.join(parts, F.col("part") == F.col("of_part"))
    place = F.col("before") + F.col("at")
    shard = F.expr(f"cast((before + at) * {int(shards)} div total as int)")
    placed = placed.withColumn("shard", shard).withColumn("place", place)
    # the first place of a shard is the smallest p with p * shards div total = shard: a ceiling
    floor = F.expr(f"(cast(shard as bigint) * total) div {int(shards)}")
    exact = F.expr(f"(cast(shard as bigint) * total) % {int(shards)} = 0")
    first = F.when(exact, floor).otherwise(floor + 1)
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).alias("slot"))
