"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark item is a set of windows of ten consecutive words (a shorter item is one window), and
every window a set of five-word shingles (a shorter window is one shingle). A window occurs in a
document only if all its shingles do, so the necessary prefix in any order is one shingle; shingles
are ordered by how often they occur in the documents, and the rarest of each window is joined.
Positional and length bounds then say where in the document the window would have to begin and end,
and the words there are compared with the window's.

The documents are scanned once. A bounded Bloom filter of the benchmark's shingles lets through the
places where one may begin; only these places, with the words around them, are stored, counted and
joined. The benchmark may have any size: it is joined, not broadcast.

Defined cases: null texts have no words and are never hit; an empty benchmark hits nothing; items
that repeat an id count once; an item without an id hits like any other and is not listed in ``items``; texts
of any length are whole; documents and ids as in ``base.documents``; extra columns are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm import bitfilter, wordscan
from troughline.llm.base import documents, python_ready, stage

WINDOW = 10
SHINGLE = 5


def _words(data, starts, ends):
    return [wordscan.LOWER[data[s:e]].tobytes().decode("utf-8") for s, e in zip(starts, ends)]


def _window_shingles(window, shingle):
    """Arrow mapper: benchmark rows to (item_id, words, text, at, h), a row for each shingle of a window."""

    def scan(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            found = {"item_id": [], "words": [], "text": [], "at": [], "size": [], "h": []}
            for first, _, data, offsets in wordscan.chunks(batch.column("text")):
                starts, ends, rows, hashes = wordscan.words(data, offsets, wordscan.ALNUM)
                bounds = wordscan.row_bounds(rows, len(offsets) - 1)
                for row in range(len(offsets) - 1):
                    lo, hi = int(bounds[row]), int(bounds[row + 1])
                    if lo == hi:
                        continue
                    names = _words(data, starts[lo:hi], ends[lo:hi])
                    length = min(window, hi - lo)
                    size = min(shingle, length)
                    keys = wordscan.grams(hashes[lo:hi], size).astype(np.int64).tolist()
                    for begin in range(hi - lo - length + 1):
                        text = " ".join(names[begin : begin + length])
                        for at in range(length - size + 1):
                            values = (ids[first + row], length, text, at, size, keys[begin + at])
                            for name, value in zip(found, values):
                                found[name].append(value)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([
                ("item_id", pa.string()), ("words", pa.int32()), ("text", pa.string()),
                ("at", pa.int32()), ("size", pa.int32()), ("h", pa.int64()),
            ]))

    return scan


def _places(shared, sizes, before, after):
    """Arrow mapper: per document its word count and the places where a benchmark shingle may begin."""
    place = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.string())])

    def scan(batches):
        known = shared.value
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            places = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in wordscan.chunks(batch.column("text")):
                starts, ends, rows, hashes = wordscan.words(data, offsets, wordscan.ALNUM)
                n = len(offsets) - 1
                bounds = wordscan.row_bounds(rows, n)
                counts[first : first + n] = np.diff(bounds)
                for size in sizes:
                    keys = wordscan.grams(hashes, size)
                    m = len(keys)
                    hit = np.flatnonzero(known.has(keys) & (rows[:m] == rows[size - 1 : size - 1 + m]))
                    for at in hit.tolist():
                        row = int(rows[at])
                        lo = max(int(bounds[row]), at - before)
                        hi = min(int(bounds[row + 1]), at + after)
                        places[first + row].append({
                            "h": int(keys[at].astype(np.int64)),
                            "at": at - int(bounds[row]),
                            "first": lo - int(bounds[row]),
                            "words": " ".join(_words(data, starts[lo:hi], ends[lo:hi])),
                        })
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(counts), pa.array(places, pa.list_(place))],
                names=["doc_id", "th", "n_words", "places"],
            )

    return scan


def occurrences(docs, benchmark, window=WINDOW, shingle=SHINGLE):
    """(documents with n_words, occurrences): doc_id, th, item_id, begin and end (word positions) of each."""
    spark = docs.sparkSession
    python_ready(spark)
    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    shingles = stage(
        items.mapInArrow(
            _window_shingles(window, shingle), "item_id string, words int, text string, at int, size int, h long"
        ),
        "benchmark-shingles",
    )
    sizes = sorted(r.size for r in shingles.select("size").distinct().collect())  # at most SHINGLE values
    known = bitfilter.build(shingles.select("h").distinct(), shingles.count(), bits_per_row=64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stage(
        docs.select("doc_id", "th", "text").mapInArrow(
            _places(known, sizes, window, window),
            f"doc_id {kind}, th long, n_words long, places array<struct<h:long,at:int,first:int,words:string>>",
        ),
        "benchmark-places",
    )
    places = scanned.where(F.size("places") > 0).select("doc_id", "th", "n_words", F.inline("places"))
    # rarity of the benchmark's shingles in the documents; a shingle that never occurs rules its windows out
    rarity = places.groupBy("h").agg(F.count(F.lit(1)).alias("places"))
    windows = (
        shingles.distinct()
        .join(rarity, "h", "left")
        .groupBy("item_id", "text", "words")
        .agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "h", F.col("at").alias("inside"))).alias("rarest"))
        .where(F.col("rarest.places") > 0)
        .select("item_id", F.col("text").alias("window"), F.col("words").alias("length"), "rarest.h", "rarest.inside")
    )
    begin = F.col("at") - F.col("inside")
    found = places.join(windows, "h").where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("words", " "), begin - F.col("first") + 1, F.col("length")), " ")
    found = found.where(there == F.col("window")).select(
        "doc_id", "th", "item_id", begin.alias("begin"), (begin + F.col("length")).alias("end")
    )
    return scanned.select("doc_id", "th", "n_words"), found


def contamination(df, benchmark, id_col="doc_id", text_col="text", window=WINDOW, shingle=SHINGLE):
    """Per document doc_id, th, n_words, n_hit (words inside an occurrence) and the sorted item ids."""
    docs, found = occurrences(documents(df, id_col, text_col), benchmark, window, shingle)
    # words covered by the union of the occurrences: what each adds beyond the ones that begin before it
    spans = found.groupBy("doc_id", "th", "begin").agg(F.max("end").alias("end"), F.collect_set("item_id").alias("items"))
    earlier = Window.partitionBy("doc_id", "th").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("covered", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "covered")))
    hits = spans.groupBy("doc_id", "th").agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    none = F.lit(None)
    rows = docs.select("doc_id", "th", "n_words", none.cast("long").alias("n_hit"), none.cast("array<string>").alias("items"))
    rows = rows.unionByName(hits.select("doc_id", "th", none.cast("long").alias("n_words"), "n_hit", "items"))
    # a document is one row of each kind at most; equal rows of a document fall together here
    merged = rows.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.max("n_hit"), F.lit(0)).alias("n_hit"),
        F.coalesce(F.max("items"), F.array().cast("array<string>")).alias("items"),
    )
    return merged.withColumn("contaminated", F.col("n_hit") > 0)
