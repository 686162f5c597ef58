"""Ranked lexical search of benchmark items over all documents by bag deduplication.

A score of an item sees of a document only the item's terms, their counts, and the length class ``m``. So
documents are first cut down to the vocabulary of the items: per document the sorted terms that it holds
and their counts. Documents of the same counts and the same ``m`` are one class (grouped by a hash, and
verified by the counts themselves); every class is scored once, and its members share the score.

Of the members of a class only the ``k`` smallest ids can be among an item's ``k`` best documents, as they
come in ascending order; likewise each task passes on the ``k`` best classes of an item, by score and
smallest member. Both follow from the ranking and lose nothing.

The items are worked on in blocks of at most about ``BLOCK_BYTES`` of text. The terms, weights and items of one
block are broadcast; documents, counts and classes never reach the driver.

Defined cases: a document is a row, also one that repeats; rows of items that repeat id and text are one
item, rows that share an id and differ in text are ranked each by itself; null and empty texts have no terms
(such documents have no score, such items no documents); null document ids come after all others, null item
ids are ids; an item of any length is part of one block; without a document that has terms there are no
rows; extra columns, whatever their names, are left out. Document ids are integers.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm import wordscan
from troughline.llm.base import BATCH_ROWS, python_ready, stage
from troughline.llm.piecetable import gather

#: UTF-8 bytes of item texts in one block: what is broadcast at once is a small multiple of it.
BLOCK_BYTES = 16 << 20
#: Scores of (class, item) that a task holds at once.
HELD_SCORES = 4_000_000
#: Candidates of a task beyond which it drops those that cannot be among the best.
HELD_CANDIDATES = 100_000

# Fixed numbers of the score.
WEIGHT_SCALE, TF_SCALE, TF_STEP, LENGTH_STEP = 1000, 1_000_000_000, 1000, 12
LENGTH_BASE, LENGTH_PART = 75, 25

_TERM = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LAST = (1 << 63) - 1


class ItemBlock:
    """The terms of a block of items: a sorted table of term hashes, and per term the items that hold it.

    ``items`` are (number of the item, terms with repeats).
    """

    def __init__(self, items):
        counts = {}
        for number, terms in items:
            for term in terms:
                of = counts.setdefault(term, {})
                of[number] = of.get(number, 0) + 1
        raw = [term.encode() for term in counts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if raw else ends
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        hashes = wordscan._hashes(data, starts, ends, wordscan.AS_IS)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[order], data
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two terms of the items share a 64-bit hash; split the items")
        self.starts, self.lengths = starts[order], (ends - starts)[order]
        terms = list(counts)
        postings = [counts[terms[k]] for k in order.tolist()]
        self.n_items = len(items)
        self.begins = np.concatenate([[0], np.cumsum([len(p) for p in postings], dtype=np.int64)]).astype(np.int64)
        self.items = np.array([i for p in postings for i in p], dtype=np.int64)
        self.repeats = np.array([n for p in postings for n in p.values()], dtype=np.int64)

    def __len__(self):
        return len(self.hashes)

    def bags(self, data, offsets):
        """Terms with repeats of each row; and the (row, term, count) of every item term in it, by row and term."""
        n = len(offsets) - 1
        starts, ends, rows, hashes = wordscan.words(data, offsets, wordscan.ALNUM)
        totals = np.bincount(rows, minlength=n)
        if not len(self):
            return totals, rows[:0], rows[:0], rows[:0]
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == ends - starts))
        at, starts, lengths = at[hit], starts[hit], (ends - starts)[hit]
        # an equal hash is no proof: the bytes are compared
        same = wordscan.LOWER[gather(data, starts, lengths)] == gather(self.data, self.starts[at], lengths)
        wrong = np.concatenate([[0], np.cumsum(~same)])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sure = wrong[bounds[1:]] == wrong[bounds[:-1]]
        keys, counts = np.unique(rows[hit][sure] * len(self) + at[sure], return_counts=True)
        return totals, keys // len(self), keys % len(self), counts

    def scores(self, weights, rows, terms, counts, m, n_rows):
        """The score of every (row, item): a table of 64-bit integers."""
        part = weights[terms] * ((TF_SCALE * counts) // (TF_STEP * counts + LENGTH_STEP * m[rows]))
        width = self.begins[terms + 1] - self.begins[terms]
        at = np.repeat(rows, width) * self.n_items + gather(self.items, self.begins[terms], width)
        table = np.zeros(n_rows * self.n_items, dtype=np.int64)
        np.add.at(table, at, np.repeat(part, width) * gather(self.repeats, self.begins[terms], width))
        return table.reshape(n_rows, self.n_items)


class _Best:
    """The ``k`` best classes of each item of a task, by score and smallest member."""

    def __init__(self, n_items, k):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.parts, self.held = [], 0

    def add(self, table, first, members):
        if len(table) > self.k:  # k classes of this table alone reach its k-th score
            self.least = np.maximum(self.least, np.partition(table, -self.k, axis=0)[-self.k])
        row, item = np.nonzero(table >= self.least)
        score, first = table[row, item], first[row]
        kept = self._order(item, score, first)
        self.parts.append((item[kept], score[kept], first[kept], members.take(pa.array(row[kept]))))
        self.held += len(kept)
        if self.held > max(HELD_CANDIDATES, 2 * self.k * len(self.least)):
            self.prune()

    def _order(self, item, score, first):
        """Places of the ``k`` best of each item, by item and rank."""
        order = np.lexsort((first, -score, item))
        item = item[order]
        return order[np.arange(len(item)) - np.searchsorted(item, item) < self.k]

    def prune(self):
        if not self.parts:
            return
        item, score, first = (np.concatenate([p[c] for p in self.parts]) for c in range(3))
        members = pa.concat_arrays([p[3] for p in self.parts])
        kept = self._order(item, score, first)
        item, score = item[kept], score[kept]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        self.parts = [(item, score, first[kept], members.take(pa.array(kept)))]
        self.held = len(kept)


def _items(items, id_col, text_col):
    """Distinct items with their terms and a block number; and the number of blocks."""
    text = F.coalesce(items[text_col].cast("string"), F.lit(""))
    rows = items.select(items[id_col].alias("item_id"), text.alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = rows.withColumn("terms", F.expr(f"regexp_extract_all({lower}, '{_TERM}', 0)"))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def _bags(docs, shared):
    """Per document its number of terms, and the item terms that it holds with their counts."""

    def cut(batches):
        block = shared.value
        for batch in batches:
            for first, last, data, offsets in wordscan.chunks(batch.column("text")):
                totals, rows, terms, counts = block.bags(data, offsets)
                bounds = pa.array(wordscan.row_bounds(rows, last - first), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (terms, counts)]
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(totals, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(cut, "doc_id long, n long, terms array<int>, tfs array<int>")


def _classes(bags, n_docs, n_terms, k):
    """One row for each distinct (terms, counts, m), with the ``k`` smallest ids of its documents."""
    m = F.expr(f"{LENGTH_BASE} + ({LENGTH_PART} * n * {n_docs}L) div {n_terms}L")
    held = bags.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    same = ["hash", "m", "terms", "tfs"]
    held = held.withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    order = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id")))
    few = held.withColumn("place", order).where(F.col("place") <= k)
    # a struct, because a list that is collected leaves nulls out
    members = F.collect_list(F.struct("doc_id"))
    first = F.coalesce(F.min("doc_id"), F.lit(_LAST))
    return few.groupBy(*same).agg(members.alias("members"), first.alias("first")).drop("hash")


def _ranked(classes, shared, weights, k):
    """The best classes of each item, a task's own ``k`` at most."""

    def score(batches):
        block = shared.value
        best = _Best(block.n_items, k)
        step = max(1, HELD_SCORES // max(1, block.n_items))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.num_rows
                terms, tfs = part.column("terms"), part.column("tfs")
                rows = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
                flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, tfs)]
                m, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("m", "first"))
                best.add(block.scores(weights.value, rows, *flat, m, n), first, part.column("members"))
        best.prune()
        for item, score_, first, members in best.parts:
            arrays = [pa.array(item, pa.int64()), pa.array(score_, pa.int64()), pa.array(first, pa.int64()), members]
            found = pa.RecordBatch.from_arrays(arrays, names=["item", "score", "first", "members"])
            for low in range(0, found.num_rows, BATCH_ROWS):
                yield found.slice(low, BATCH_ROWS)

    found = classes.mapInArrow(score, "item long, score long, first long, members array<struct<doc_id:long>>")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("first")))
    found = found.withColumn("place", place).where(F.col("place") <= k)
    found = found.select("item", "score", F.inline("members"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs, items, k=20, doc_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    python_ready(spark)
    items, blocks = _items(items, item_col, item_text_col)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[doc_col].cast("long").alias("doc_id"), text.alias("text"))
    results = []
    for number in range(blocks):
        found = items.where(F.col("block") == number).select("item_id", "terms").collect()
        block = ItemBlock([(i, row.terms) for i, row in enumerate(found)])
        shared = spark.sparkContext.broadcast(block)
        bags = stage(_bags(docs, shared), "bags")
        n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(block), dtype=np.int64)
        for term, df in bags.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[term] = math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))
        ranked = _ranked(_classes(bags, n_docs, n_terms, k), shared, spark.sparkContext.broadcast(weights), k)
        kind = items.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(found)], f"item long, item_id {kind}")
        results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = results[0]
    for more in results[1:]:
        whole = whole.union(more)
    return whole
