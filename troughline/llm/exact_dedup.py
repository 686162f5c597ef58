"""Exact deduplication with two passes over a Bloom filter.

The first pass marks the hashes of all rows in a filter that counts to two. The second pass looks
every row up: a row whose hash was certainly seen once is its own group and passes straight
through. Only the rows that may repeat are shuffled, and they are grouped by the SHA-256 of the
whole normalised text, so a false positive of the filter costs a shuffled row and nothing else.

Defined cases: null text counts as empty, and all empty texts are equal; a null id sorts before
every other id; of rows that repeat id and text too one stays; texts of any length are hashed whole;
extra columns pass through under their own names, beside new ones that begin with ``prefix``, or with as
many underscores before it as it takes to begin like none of them; no rows give no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from troughline.llm import bitfilter
from troughline.llm.base import python_ready, stage

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def free_prefix(df, prefix="dedup_"):
    """``prefix``, with underscores in front while a column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def exact_groups(df, id_col="doc_id", text_col="text", prefix="dedup_"):
    """Every row of ``df`` with ``<prefix>sha256``, ``<prefix>keep_id``, ``<prefix>size``, ``<prefix>kept``."""
    spark = df.sparkSession
    python_ready(spark)
    prefix = free_prefix(df, prefix)
    sha, keep, size, kept, maybe = (prefix + name for name in ("sha256", "keep_id", "size", "kept", "maybe"))
    rows = df.withColumn(sha, F.sha2(normalised(df[text_col]), 256))
    # the leading 64 bits of the digest serve as the hash of the filter
    hash64 = F.xxhash64(F.col(sha))
    total = df.select(F.count(F.lit(1))).first()[0]
    repeats = bitfilter.build(rows.select(hash64), total, twice=True)

    @F.pandas_udf(BooleanType())
    def may_repeat(hashes: pd.Series) -> pd.Series:
        return pd.Series(repeats.value.has(hashes.to_numpy().astype(np.int64)))

    rows = rows.withColumn(maybe, may_repeat(hash64))
    single = (
        rows.where(~F.col(maybe))
        .withColumn(keep, F.col(id_col))
        .withColumn(size, F.lit(1).cast("long"))
        .withColumn(kept, F.lit(True))
    )
    shuffled = rows.where(F.col(maybe))
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.col(id_col).alias("id"), F.xxhash64(*plain).alias("tie"))
    group_key, least, equal = prefix + "group", prefix + "least", prefix + "equal"
    groups = (
        shuffled.groupBy(F.col(sha).alias(group_key), order.alias(least))
        .agg(F.count(F.lit(1)).alias(equal))
        .groupBy(group_key)
        .agg(F.sum(equal).alias(size), F.min(F.struct(least, equal)).alias(least))
    )
    # stored, so that the join sees a small table and can split a group that a third of the rows are in
    groups = stage(groups, "copies")
    joined = (
        shuffled.join(groups, F.col(sha) == F.col(group_key))
        .withColumn(keep, F.col(f"{least}.{least}.id"))
        .withColumn(kept, order == F.col(f"{least}.{least}"))
    )
    columns = [*df.columns, sha, keep, size, kept]
    out = single.select(*columns).unionByName(joined.select(*columns))
    if groups.where(F.col(f"{least}.{equal}") > 1).isEmpty():
        return out
    # rows equal in every column cannot be told apart by order: they are numbered, and one of them stays
    other = F.when(~F.col(kept), F.xxhash64(id_col))  # spreads the rows that go
    first = F.row_number().over(Window.partitionBy(sha, kept, other).orderBy(F.lit(0))) == 1
    return single.select(*columns).unionByName(joined.withColumn(kept, F.col(kept) & first).select(*columns))


def exact_dedup(df, id_col="doc_id", text_col="text"):
    """The rows of ``df`` that stay: of equal texts the row with the smallest id."""
    prefix = free_prefix(df)
    return exact_groups(df, id_col, text_col, prefix).where(F.col(prefix + "kept")).select(*df.columns)
