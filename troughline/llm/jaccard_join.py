"""Near duplicates by an exact Jaccard join of shingle sets, heavy and light by size.

Documents with equal sets are one class. Classes are joined in two ways, by the size of their set:

* Small sets enumerate their subsets. Two sets of sizes s and t reach the similarity exactly if they
  share a subset of the fixed size that s and t ask for, so equal subset keys are links without a check.
* Large sets scan inverted lists. The shingles of a set are ordered by rarity; a partner must share one of
  the first ones, its prefix, and length and positional bounds hold for the first shared shingle. What
  passes is verified on whole sets.

The boundary between the two is the size at which the summed costs are least: subsets on one side, the
lengths of the lists that would be read on the other, both counted on the data.

Links only matter for which class they connect. A list of many similar sets is therefore not expanded to
all pairs: in each round every member is verified against one member of its lists, linked classes merge,
and in the end only pairs that are still in different components are verified, each exactly once. No link
between different components is missed. A list whose members are in one component stays closed, so a round
goes on with the open lists of the one before, and merges components by that round's links alone. The first
round's partner is the member with the smallest share of shingles of its own, the middle of a group of copies.

The last join makes a pair at the lists in which none of the shingles just before is shared too: the first shared
one is always such a list, and similar sets have few others. Bitmaps of odd counts (Sandes et al.) bound what two
sets can share, and only pairs within the bound are verified.

Pairs carry classes and sizes only. Whole sets are kept without the shingles that certainly are in one document
alone (their number is kept), and of them only the sets of a round's pairs are shuffled.

Rarity is the count of a shingle's bucket in a sketch of fixed size; it decides the order alone, never a
result. Defined cases: null and empty texts have no shingles and are linked with nothing; documents and
repeated rows as in ``base.documents``; a component whose ids are all null has a null id.
"""

import hashlib
import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm import bitfilter, wordscan
from troughline.llm.base import documents, python_ready, release, stage
from troughline.llm.components import connected

SHINGLE = 5
#: Similarity as a fraction: links have ``DEN * intersection >= NUM * union``.
NUM, DEN = 80, 100
#: Buckets of the rarity sketch.
SKETCH_BITS = 20
SKETCH_SEGMENT = 1 << 16
#: Sets of more shingles are never enumerated.
MAX_SMALL = 12
#: Rounds of one-partner verification at most, before all open pairs are verified. A second one linked next to nothing.
STAR_ROUNDS = 1
#: Open entries of a class before one that are compared to make a pair in fewer of its lists.
BEFORE = 4
#: Bits of a set's bitmap of odd counts.
ODD_BITS = 1024
PAIR = "a binary, b binary, root_a binary, root_b binary"
#: Open pairs, as a multiple of the list entries, that are verified without another such round.
OPEN_PAIRS = 2


def needed(s, t):
    """Shared shingles that sets of sizes s and t need."""
    return -(-NUM * (s + t) // (NUM + DEN))


def prefix_length(s):
    return s - -(-NUM * s // DEN) + 1


def subset_sizes(s, limit):
    """Sizes of the subsets that decide for a set of size s and any partner up to ``limit``."""
    lowest, highest = -(-NUM * s // DEN), min(DEN * s // NUM, limit)
    return sorted({needed(s, t) for t in range(lowest, highest + 1)})


def _class_of(shingles):
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(inside, size):
    """Arrow mapper: a row a document (class and set size), and at the end a task's rarity sketch."""

    def scan(batches):
        release()
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            sizes, classes = [], []
            for _, _, data, offsets in wordscan.chunks(batch.column("text")):
                sets = wordscan.shingle_sets(data, offsets, inside, size)
                sizes += [len(s) for s in sets]
                classes += [_class_of(s) for s in sets]
                every = np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)
                counts += np.bincount(every.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int32()),
                    pa.array(classes, pa.binary()), pa.nulls(n, pa.int32()),
                ],
                names=["doc_id", "th", "n", "c", "segment"],
            )
        if kind is not None and counts.any():
            blocks = [zlib.compress(b.tobytes(), 1) for b in counts.reshape(-1, SKETCH_SEGMENT)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                    pa.array(blocks, pa.binary()), pa.array(range(n), pa.int32()),
                ],
                names=["doc_id", "th", "n", "c", "segment"],
            )

    return scan


def _rarity(scanned):
    """Bucket counts of all documents on a log scale, one byte a bucket."""
    parts = scanned.where("segment is not null").select("segment", F.col("c").alias("block"))

    def add(batches):
        total = {}
        for batch in batches:
            for segment, block in zip(batch.column("segment").to_pylist(), batch.column("block").to_pylist()):
                counts = np.frombuffer(zlib.decompress(block), dtype=np.uint32).astype(np.uint64)
                total[segment] = total[segment] + counts if segment in total else counts
        for segment, counts in total.items():
            scale = np.minimum(255, np.floor(6 * np.log2(1.0 + counts))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([scale.tobytes()], pa.binary())], names=["segment", "scale"]
            )

    scale = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in parts.repartition(SKETCH_SEGMENT >> 12, "segment").mapInArrow(add, "segment int, scale binary").collect():
        scale[row.segment * SKETCH_SEGMENT : (row.segment + 1) * SKETCH_SEGMENT] = np.frombuffer(row.scale, dtype=np.uint8)
    return scale


def _all_shingles(inside, size):
    """The shingles of a batch of texts, each once a document."""

    def hashes(batch):
        found = [s for _, _, data, offsets in wordscan.chunks(batch.column(0)) for s in wordscan.shingle_sets(data, offsets, inside, size)]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    return hashes


def _list_values(batch):
    return batch.column(0).flatten().to_numpy(zero_copy_only=False)


def _prefixes(shared, common, inside, size):
    """Arrow mapper: class, set size and shingles in order of rarity, a small set whole, others the prefix.

    A set whose whole prefix are shingles of no other document is left out: it has no partner.
    """

    def scan(batches):
        scale, repeated = shared.value, common.value
        for batch in batches:
            classes, sizes, heads = [], [], []
            for _, _, data, offsets in wordscan.chunks(batch.column("text")):
                for shingles in wordscan.shingle_sets(data, offsets, inside, size):
                    n = len(shingles)
                    if not n:
                        continue
                    maybe = repeated.has(shingles)
                    if n - np.count_nonzero(maybe) >= prefix_length(n):
                        continue
                    bucket = (shingles & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
                    order = np.lexsort((shingles, scale[bucket], maybe))
                    classes.append(_class_of(shingles))
                    sizes.append(n)
                    heads.append(shingles[order[: n if n <= MAX_SMALL else prefix_length(n)]].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64()))],
                names=["c", "s", "head"],
            )

    return scan


def _entries(shared):
    """Arrow mapper: list entries of tokens that may repeat.

    Token, class, size, place in the order, and the share (in thousandths) of the prefix's tokens that do not repeat.
    """

    def scan(batches):
        repeated = shared.value
        for batch in batches:
            heads = batch.column("head")
            bounds = heads.offsets.to_numpy()
            tokens = heads.values.to_numpy(zero_copy_only=False)
            base = int(bounds[0]) if len(bounds) else 0
            tokens = tokens[base : int(bounds[-1])] if len(bounds) else tokens[:0]
            lengths = np.diff(bounds)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            places = np.arange(len(tokens)) - np.repeat(bounds[:-1] - base, lengths)
            sizes = batch.column("s").to_numpy()
            prefix = sizes - -(-NUM * sizes.astype(np.int64) // DEN) + 1
            inside, again = places < prefix[rows], repeated.has(tokens)
            alone = np.bincount(rows[inside & ~again], minlength=batch.num_rows) * 1000 // np.maximum(sizes, 1)
            kept = np.flatnonzero(inside & again)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[kept]), batch.column("c").take(pa.array(rows[kept])),
                    pa.array(sizes[rows[kept]], pa.int32()), pa.array(places[kept], pa.int32()),
                    pa.array(alone[rows[kept]], pa.int32()),
                ],
                names=["token", "c", "s", "at", "alone"],
            )

    return scan


def _subsets(limit):
    """Arrow mapper: (key, size of the subset, class, size) for all deciding subsets of small sets."""

    def scan(batches):
        for batch in batches:
            keys, picks, classes, sizes = [], [], [], []
            for c, s, head in zip(*(batch.column(x).to_pylist() for x in ("c", "s", "head"))):
                tokens = np.sort(np.array(head, dtype=np.int64))
                for pick in subset_sizes(s, limit):
                    for chosen in combinations(range(s), pick):
                        keys.append(hashlib.blake2b(tokens[list(chosen)].tobytes(), digest_size=16).digest())
                        picks.append(pick)
                        classes.append(c)
                        sizes.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(picks, pa.int32()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32())],
                names=["key", "pick", "c", "s"],
            )

    return scan


def _whole_sets(wanted, common, inside, size):
    """Arrow mapper: class, set size, bitmap and sorted 64-bit hashes of the shingles that another document may have.

    Only of classes that the filter ``wanted`` lets through. The bitmap is of the whole set.
    """

    def scan(batches):
        classes_wanted, repeated = wanted.value, common.value
        for batch in batches:
            classes, sizes, odd, sets = [], [], [], []
            for _, _, data, offsets in wordscan.chunks(batch.column("text")):
                for shingles in wordscan.shingle_sets(data, offsets, inside, size):
                    if len(shingles):
                        c = _class_of(shingles)
                        if classes_wanted.has(np.frombuffer(c[:8], dtype="<i8"))[0]:
                            classes.append(c)
                            sizes.append(len(shingles))
                            odd.append(_odd(shingles))
                            sets.append(shingles[repeated.has(shingles)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), pa.array(sets, pa.binary())],
                names=["c", "n", "odd", "shingles"],
            )

    return scan


def _odd(shingles):
    """Bitmap of the buckets that hold an odd number of the shingles."""
    bucket = (shingles >> np.uint64(20)) & np.uint64(ODD_BITS - 1)
    return np.packbits((np.bincount(bucket.astype(np.int64), minlength=ODD_BITS) & 1).astype(bool)).tobytes()


def _within(batches):
    """Arrow mapper: the pairs whose bitmaps leave room for the similarity.

    A bucket in which the bitmaps differ has a shingle that the sets do not share.
    """
    for batch in batches:
        n, m = (batch.column(x).to_numpy().astype(np.int64) for x in ("n", "m"))
        x, y = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(len(n), ODD_BITS // 64) for c in ("x", "y")
        )
        most = (n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
        kept = np.flatnonzero(DEN * most >= NUM * (n + m - most))
        yield batch.select(["a", "b", "root_a", "root_b"]).take(pa.array(kept))


def _named(known):
    """Arrow mapper: the rows whose class the filter lets through."""

    def scan(batches):
        for batch in batches:
            heads = np.array([int.from_bytes(c[:8], "little", signed=True) for c in batch.column("c").to_pylist()], dtype=np.int64)
            yield batch.take(pa.array(np.flatnonzero(known.value.has(heads))))

    return scan


def _verify(batches):
    """Arrow mapper: pairs with both sets to the pairs that reach the similarity."""
    for batch in batches:
        kept = []
        for k, (x, y, n, m) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("x", "y", "n", "m")))):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if DEN * shared >= NUM * (n + m - shared):
                kept.append(k)
        yield batch.select(["a", "b", "root_a", "root_b"]).take(pa.array(kept, pa.int64()))


def _small_boundary(sets, entries):
    """Size up to which subsets cost less than lists, from what both would cost on these sets."""
    count = {r.s: r.n for r in sets.where(F.col("s") <= MAX_SMALL).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    small = entries.where(F.col("s") <= MAX_SMALL).join(lists, "token")
    read = {r.s: r.n for r in small.groupBy("s").agg(F.sum("length").alias("n")).collect()}
    best, boundary, cost = 0, 0, 0
    for s in range(1, MAX_SMALL + 1):
        subsets = sum(math.comb(s, k) for k in subset_sizes(s, MAX_SMALL))
        cost += count.get(s, 0) * subsets - read.get(s, 0)
        if cost <= best:
            best, boundary = cost, s
    return boundary


def _possible(s, at, t, place):
    """Length and positional bound of two sets that share a shingle at these places."""
    need = F.ceil(F.lit(NUM) * (s + t) / F.lit(NUM + DEN))
    room = F.least(s - at, t - place)
    return (DEN * F.least(s, t) >= NUM * F.greatest(s, t)) & (room >= need)


def class_links(docs, scanned, inside=wordscan.SPACED, size=SHINGLE):
    """(node, root) of all classes that are linked with another one."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(_rarity(scanned))
    # shingles that are certainly in one document alone come first; a set with enough of them has no partner
    every = scanned.select(F.sum("n")).first()[0] or 0
    common = bitfilter.build(
        docs.select("text"), every, twice=True, bits_per_row=8, probes=1, hashes=_all_shingles(inside, size)
    )
    heads = docs.select("text").mapInArrow(_prefixes(rarity, common, inside, size), "c binary, s int, head array<long>")
    sets = stage(heads.groupBy("c").agg(F.first("s").alias("s"), F.first("head").alias("head")), "sets")
    total = sets.select(F.sum(F.size("head")).alias("n")).first().n or 0
    repeated = bitfilter.build(sets.select("head"), total, twice=True, hashes=_list_values)
    entries = sets.mapInArrow(_entries(repeated), "token long, c binary, s int, at int, alone int")
    entries = stage(entries, "entries")
    repeated.destroy()
    rarity.destroy()
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = stage(entries.join(shared.select("token"), "token"), "lists")

    boundary = _small_boundary(sets, entries)
    keys = sets.where(F.col("s") <= boundary).mapInArrow(_subsets(boundary), "key binary, pick int, c binary, s int")
    # of the sets with a common subset, all that link within the group link with its smallest
    smallest = keys.groupBy("key").agg(F.min(F.struct("s", "c")).alias("first"))
    pairs = keys.join(smallest, "key").where(
        (F.col("c") != F.col("first.c"))
        & (F.ceil(F.lit(NUM) * (F.col("s") + F.col("first.s")) / F.lit(NUM + DEN)) <= F.col("pick"))
    )
    links = stage(pairs.select(F.col("first.c").alias("a"), F.col("c").alias("b")).distinct(), "small-links")

    wanted = entries.select("c").distinct().select(_head64("c").alias("h"))
    wanted = stage(wanted, "wanted")
    known = bitfilter.build(wanted, wanted.count())
    whole = docs.select("text").mapInArrow(_whole_sets(known, common, inside, size), "c binary, n int, odd binary, shingles binary")
    whole = whole.groupBy("c").agg(*(F.first(x).alias(x) for x in ("n", "odd", "shingles")))
    whole = stage(whole, "whole-sets")
    known.destroy()
    common.destroy()

    labels = connected(links).withColumnRenamed("node", "c")
    current = entries.join(labels, "c", "left").withColumn("root", F.coalesce("root", "c"))
    tried = links
    for turn in range(STAR_ROUNDS + 1):
        current = stage(current, "current")
        by_root = current.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
        open_lists = by_root.groupBy("token").agg(
            F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same")
        )
        open_lists = stage(open_lists.where("roots > 1"), "open-lists")
        open_pairs, members = open_lists.select(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.sum("all")).first()
        if not members:
            break
        last = turn == STAR_ROUNDS or open_pairs <= OPEN_PAIRS * members
        current = current.join(open_lists.select("token"), "token")
        found = _all_open(current, boundary) if last else _one_each(current, boundary, turn)
        found = found.join(tried, ["a", "b"], "left_anti")
        if last:
            found = _with_sets(found, whole.select("c", "n", "odd"), "odd").mapInArrow(_within, PAIR)
        found = stage(found, "candidates")
        merged = connected(_checked(found, whole), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("into"))
        # the classes of a merged root go along; one that no label names is a class by itself
        labels = labels.join(merged, "root", "full").select(
            F.coalesce("c", "root").alias("c"), F.coalesce("into", "root").alias("root")
        )
        if last:
            break
        tried = tried.union(found.select("a", "b"))
        current = current.join(merged, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
    return labels.withColumnRenamed("c", "node")


def _head64(c):
    """The first eight bytes of a class as a long, as numpy reads them."""
    swapped = F.concat(*[F.substring(F.hex(c), 2 * k + 1, 2) for k in range(7, -1, -1)])
    return F.conv(swapped, 16, -10).cast("long")


def _ordered_pairs(rows):
    """Pairs (c, d) with the smaller class first, each with its root."""
    swapped = F.col("c") > F.col("d")
    return rows.select(
        F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"),
        F.when(swapped, F.col("root_d")).otherwise(F.col("root")).alias("root_a"),
        F.when(swapped, F.col("root")).otherwise(F.col("root_d")).alias("root_b"),
    )


def _one_each(current, boundary, turn):
    """Every member with the one member of its lists that most of its lists name."""
    # the member with the fewest tokens of its own is in the middle of a group of copies; later any other
    draw = F.struct(F.col("alone") if turn == 0 else F.lit(0), F.xxhash64("c", F.lit(turn)))
    first = current.groupBy("token").agg(
        F.min(F.struct(draw.alias("draw"), "c", "s", "at", "root")).alias("p")
    )
    pairs = current.join(first, "token").where(F.col("root") != F.col("p.root"))
    pairs = pairs.where((F.col("s") > boundary) | (F.col("p.s") > boundary))
    pairs = pairs.where(_possible(F.col("s"), F.col("at"), F.col("p.s"), F.col("p.at")))
    counts = pairs.groupBy("c", "root", F.col("p.c").alias("d"), F.col("p.root").alias("root_d")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c", "root").agg(F.max(F.struct("n", "d", "root_d")).alias("m"))
    return _ordered_pairs(best.select("c", "root", F.col("m.d").alias("d"), F.col("m.root_d").alias("root_d"))).distinct()


def _all_open(current, boundary):
    """All pairs that share a list and are still in different components, once each, if they can be similar.

    The first shared shingle of a pair leaves the most room behind it, and no shingle before it is shared. A shared one
    before it would be in an open list too, so a list with one among the entries just before it need not make the pair.
    """
    before = F.collect_list("token").over(Window.partitionBy("c").orderBy("at").rowsBetween(-BEFORE, -1))
    mine = current.select("token", "c", "s", "at", "root", before.alias("before"))
    other = mine.select(
        "token", F.col("c").alias("d"), F.col("s").alias("t"), F.col("at").alias("place"),
        F.col("root").alias("root_d"), F.col("before").alias("before_d"),
    )
    pairs = mine.join(other, "token").where((F.col("c") < F.col("d")) & (F.col("root") != F.col("root_d")))
    pairs = pairs.where((F.col("s") > boundary) | (F.col("t") > boundary))
    pairs = pairs.where(_possible(F.col("s"), F.col("at"), F.col("t"), F.col("place")))
    pairs = pairs.where(~F.arrays_overlap("before", "before_d"))
    return _ordered_pairs(pairs.select("c", "root", "d", "root_d")).distinct()


def _with_sets(pairs, sets, value):
    """Pairs with the sizes n and m and a column of both classes as x and y."""
    left = sets.select(F.col("c").alias("a"), F.col("n"), F.col(value).alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "root_a", "root_b", "n", "m", "x", "y")


def _checked(pairs, whole):
    """The similar ones of ``pairs``; sets of other classes are left out before the shuffle."""
    named = stage(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().select(_head64("c")), "wanted")
    known = bitfilter.build(named, named.count())
    sets = whole.select("c", "n", "shingles")
    both = _with_sets(pairs, sets.mapInArrow(_named(known), sets.schema), "shingles")
    good = stage(both.mapInArrow(_verify, PAIR), "verified")
    known.destroy()
    return good


def near_duplicates(df, id_col="doc_id", text_col="text", inside=wordscan.SPACED, size=SHINGLE):
    """Per document doc_id, th, n_shingles, component_id (the smallest id that links reach) and keeper_th.

    The one document of a component that stays is (component_id, keeper_th), also when ids repeat or are all null.
    """
    spark = df.sparkSession
    python_ready(spark)
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select("doc_id", "th", "text").mapInArrow(
        _signatures(inside, size), f"doc_id {kind}, th long, n int, c binary, segment int"
    )
    scanned = stage(scanned, "signatures")
    labels = class_links(docs, scanned, inside, size)
    rows = scanned.where("segment is null").select("doc_id", "th", "n", "c").distinct()
    # an empty set is linked with nothing
    classes = rows.join(labels.select(F.col("node").alias("c"), "root"), "c", "left")
    classes = stage(classes.select("doc_id", "th", "n", F.coalesce("root", "c").alias("root")), "classes")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th"))
    smallest = classes.where("n > 0").groupBy("root").agg(
        F.min("doc_id").alias("component_id"), keeper["th"].alias("keeper_th")
    )
    count = F.col("n").cast("long").alias("n_shingles")
    joined = classes.where("n > 0").join(smallest, "root").select("doc_id", "th", count, "component_id", "keeper_th")
    empty = classes.where("n = 0").select("doc_id", "th", count, F.col("doc_id").alias("component_id"), F.col("th").alias("keeper_th"))
    return joined.unionByName(empty)
