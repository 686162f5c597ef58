"""Passages that repeat across documents, found through a sparse suffix array.

Only suffixes at content-selected positions are kept: in every run of ``window`` consecutive words the
position whose shingle hash is smallest among those that start a whole shingle (a minimiser). Equal
passages of that length select the same position, so each is represented by one suffix of its own.

1. The suffixes are ordered by their first words (their shingle), with the hash of the group of passages that
   each represents, and a suffix without an equal neighbour from another document is dropped. Where all suffixes
   of one shingle have the same group, as in copies, the group is settled as one range of places.
2. The remaining suffixes are extended: to the left by each number of words for which they represent a
   passage, to the right to the passage's full length. Equal extended passages are neighbours in the order
   of their content; they are compared by grouping, with partial counts before the shuffle, so that
   a passage in a third of all documents is one row a task and not one task's work.
3. Extended matches that overlap or adjoin are joined to maximal spans.

Comparing sorted neighbours alone would miss a passage whenever a suffix's neighbour shares more to the
right but not the words to the left; extending before the comparison finds every repeated passage.

Words are runs of bytes that are not ASCII white space, as they are written. Passages are compared by a
64-bit hash of all their words. Defined cases: null, empty and short texts have no passages; rows
that share an id are one document, so a text does not repeat itself; null ids are one document; rows that
repeat id and text give their spans once; extra columns are left out.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from troughline.llm import bitfilter, wordscan
from troughline.llm.base import documents, python_ready, stage

#: Words of the shortest passage, and of the shingle that orders suffixes.
MIN_WORDS = 50
SHINGLE = 8


def _minimisers(keys, window):
    """For each run of ``window`` keys the position of its smallest, the leftmost of equal ones."""
    n = len(keys) - window + 1
    # smallest of doubling stretches, then two overlapping stretches cover the window
    stretch, low, where = 1, keys, np.arange(len(keys))
    while stretch * 2 <= window:
        m = len(low) - stretch
        right = low[stretch:] < low[:m]
        low, where = np.where(right, low[stretch:], low[:m]), np.where(right, where[stretch:], where[:m])
        stretch *= 2
    shift = window - stretch
    right = low[shift : shift + n] < low[:n]
    return np.where(right, where[shift : shift + n], where[:n])


def _selected(batch, min_words, shingle):
    """Per row of a batch with long enough texts: row, shingle hashes and selected position of each passage."""
    window = min_words - shingle + 1
    for first, _, data, offsets in wordscan.chunks(batch.column("text")):
        starts, ends, rows, hashes = wordscan.words(data, offsets, wordscan.SPACED, fold=wordscan.AS_IS)
        bounds = wordscan.row_bounds(rows, len(offsets) - 1)
        keys, passages = wordscan.grams(hashes, shingle), wordscan.grams(hashes, min_words)
        for row in np.flatnonzero(np.diff(bounds) >= min_words):
            lo, hi = bounds[row], bounds[row + 1]
            yield first + int(row), keys[lo : hi - shingle + 1], _minimisers(keys[lo : hi - shingle + 1], window), passages[lo : hi - min_words + 1]


def _suffixes(min_words, shingle):
    """Arrow mapper: place and shingle hash ``h`` of each selected suffix, number and hash ``g`` of its passages."""
    # a selected position lies inside each of its passages, so they are at most as many as the window has positions
    weights = np.full(min_words - shingle + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    weights = np.multiply.accumulate(weights)

    def scan(batches):
        for batch in batches:
            rows, begins, sizes, shingles, groups = [], [], [], [], []
            for row, keys, at, passages in _selected(batch, min_words, shingle):
                begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                n = np.diff(begin, append=len(at))
                steps = np.arange(len(at)) - np.repeat(begin, n)
                rows.append(np.full(len(begin), row))
                begins.append(begin)
                sizes.append(n)
                shingles.append(keys[at[begin]])
                groups.append(wordscan.mix(np.add.reduceat(passages * weights[steps], begin) + n.astype(np.uint64)))
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("th").take(at),
                    pa.array(np.concatenate(begins), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()),
                    pa.array(np.concatenate(shingles).astype(np.int64)), pa.array(np.concatenate(groups).astype(np.int64)),
                ],
                names=["doc_id", "th", "begin", "n", "h", "g"],
            )

    return scan


def _passages(shared, min_words, shingle):
    """Arrow mapper: hash and place of every passage whose suffix may be in the filter."""

    def scan(batches):
        wanted = shared.value
        for batch in batches:
            rows, begins, hashes = [], [], []
            for row, keys, at, passages in _selected(batch, min_words, shingle):
                chosen, back = np.unique(at, return_inverse=True)
                kept = np.flatnonzero(wanted.has(keys[chosen])[back])
                rows.append(np.full(len(kept), row))
                begins.append(kept)
                hashes.append(passages[kept])
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("th").take(at),
                    pa.array(np.concatenate(begins), pa.int32()), pa.array(np.concatenate(hashes).astype(np.int64)),
                ],
                names=["doc_id", "th", "begin", "passage"],
            )

    return scan


def repeated_passages(df, id_col="doc_id", text_col="text", min_words=MIN_WORDS, shingle=SHINGLE):
    """Rows doc_id, th, begin, end (word positions), n_words, first_doc, later.

    A row is a maximal run of words covered by passages of ``min_words`` words that occur in at least
    two documents. ``later`` spans occur in a document with a smaller id too (``first_doc`` is the smallest):
    removing them leaves each passage in the document where it comes first.
    """
    spark = df.sparkSession
    python_ready(spark)
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    suffixes = docs.mapInArrow(
        _suffixes(min_words, shingle), f"doc_id {kind}, th long, begin int, n int, h long, g long"
    )
    suffixes = stage(suffixes, "suffixes")
    known = bitfilter.build(suffixes.select("h"), suffixes.count(), twice=True)

    @F.pandas_udf(BooleanType())
    def repeated(hashes: pd.Series) -> pd.Series:
        return pd.Series(known.value.has(hashes.to_numpy()))

    suffixes = stage(suffixes.where(repeated("h")), "repeated-suffixes")
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least")
    most = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("most")
    shared = suffixes.groupBy(F.col("h").alias("key")).agg(least, most, (F.min("g") == F.max("g")).alias("whole"))
    shared = shared.where(F.col("least") != F.col("most")).select("key", F.col("least.doc_id").alias("first_doc"), "whole")
    shared = stage(shared, "shingles")
    wholes = _marked(suffixes, "h", shared.where("whole").drop("whole"))

    # shingles with different words around them: their passages are told apart one by one
    others = shared.where(~F.col("whole")).select("key")
    others = bitfilter.build(others, others.count())
    passages = docs.mapInArrow(
        _passages(others, min_words, shingle), f"doc_id {kind}, th long, begin int, passage long"
    )
    passages = stage(passages, "passages")
    owners = passages.groupBy(F.col("passage").alias("key")).agg(least, most)
    owners = stage(owners.where(F.col("least") != F.col("most")).select("key", F.col("least.doc_id").alias("first_doc")), "owners")
    singles = _marked(passages.withColumn("n", F.lit(1)), "passage", owners)
    return _joined(wholes.unionByName(singles), min_words)


def _marked(places, hashes, owners):
    """The places (``n`` passages from ``begin`` on) whose hash has an owner, with the owner and whether it is another."""
    marked = places.join(owners, F.col(hashes) == F.col("key"))
    later = ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    return marked.select("doc_id", "th", "begin", "n", later.alias("later"), "first_doc")


def _joined(marked, min_words):
    """Spans of each document from the places of its passages, those of first and later ones apart.

    Rows that repeat id and text give the same places again, as does a false hit of a filter, which changes no span.
    """
    own = Window.partitionBy("doc_id", "th", "later").orderBy("begin")
    last = F.col("begin") + F.col("n") - 1
    before = F.max(last).over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("begin") > before + min_words)).cast("int")
    runs = marked.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "th", "later", "run").agg(
        F.min("begin").alias("begin"), (F.max(last) + min_words).alias("end"), F.min("first_doc").alias("first_doc")
    )
    return spans.select("doc_id", "th", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "first_doc", "later")


def without_repeats(df, id_col="doc_id", text_col="text", min_words=MIN_WORDS, shingle=SHINGLE):
    """``doc_id`` and ``text`` with the words of later spans cut out, a row a document."""
    docs = documents(df, id_col, text_col)
    spans = repeated_passages(df, id_col, text_col, min_words, shingle).where("later")
    # spans of one document do not overlap: there are at most its words divided by ``min_words`` of them
    cuts = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "cuts")
    joined = docs.distinct().join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("th") == F.col("cut_th")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("cuts").to_pylist()):
                if spans:
                    texts[k] = _cut(texts[k].encode("utf-8"), spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return joined.select("doc_id", "text", "cuts").mapInArrow(cut, f"doc_id {kind}, text string")


def _cut(raw, spans):
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _, _ = wordscan.words(data, np.array([0, len(data)]), wordscan.SPACED, fold=wordscan.AS_IS)
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : starts[span["begin"]]])
        at = ends[span["end"] - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8")
