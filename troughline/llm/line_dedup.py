"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct five-word shingles (a line of fewer words is one token). Lines with
equal token sets are one class. For the classes that differ, tokens are ordered by rarity and the first
ones, the prefix, are joined: two sets of Jaccard similarity 0.8 or more share one. Length and positional
bounds drop pairs, the rest are verified on whole sets. A line goes when an earlier line, by id
and place in its text, is similar or equal; it does not matter whether that line goes too.

A list of many similar lines is not expanded to all pairs: each class is first verified against the earliest
class of its lists, and only classes that this leaves open are verified against all earlier ones.

Rarity comes from a fixed number of counters over all tokens; it decides the order alone. Which tokens more than
one line has, and which lines are compared as whole sets, is looked up in broadcast bits of bounded size, a false
hit of which costs a row and no more. Token sets are taken from the text again when they are compared, and
staged tables are deleted when no later step reads them.

Lines end at line feeds; words are split at ASCII white space, A-Z compared in lower case. Token sets are
told apart by a 64-bit hash. Defined cases: lines without words have no tokens and always stay, as do
null and empty texts (one empty line); documents and repeated rows as in ``base.documents``; null ids come
first; extra columns are left out.
"""

from pyspark.sql import functions as F

from troughline.llm.base import bind, discard, documents, stage

SHINGLE = 5
NUM, DEN = 80, 100
#: Counters of the rarity sketch, and the most bits of a table of bits.
COUNTERS = 1 << 16
MAX_BITS = 1 << 27

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(docs):
    """A row a line: doc_id, th, line_no from 0, line."""
    return docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def tokens_of(line):
    """Distinct shingle hashes of a line."""
    words = F.array_remove(F.split(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D]+", -1), "")

    def shingles(h):
        starts = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        full = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)])))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= SHINGLE, full).when(F.size(h) > 0, F.array(F.xxhash64(h, F.lit(0)))).otherwise(none)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _counter(token):
    return token.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def _rarity(lines):
    """A number from 0 to 255 a counter, larger for more frequent tokens: COUNTERS numbers reach the driver."""
    counts = lines.select(F.explode(tokens_of(F.col("line"))).alias("token")).groupBy(_counter(F.col("token")).alias("k"))
    scale = [0] * COUNTERS
    for row in counts.agg(F.count(F.lit(1)).alias("n")).collect():
        scale[row.k] = min(255, int(16 * (row.n.bit_length() + row.n / (1 << row.n.bit_length()))) // 3)
    # one text, which the optimizer turns into one array
    return F.split(F.lit(",".join(map(str, scale))), ",").cast("array<int>")


PLACE = ("doc_id", "th", "line_no")


def _classed(lines, scale):
    """Per line with words its place, the key and size of its token set, and its prefix.

    A token of a prefix is its rarity and 55 bits of its hash in one number. Tokens that fall together there make more
    pairs and lose none.
    """

    def ranked(t):
        rarity = F.get(scale, _counter(t)).cast("bigint")
        return F.shiftleft(rarity, 55).bitwiseOR(F.shiftrightunsigned(t, 9))

    def classed(tokens):
        size = F.size(tokens)
        length = size - F.ceil(size * F.lit(NUM) / F.lit(DEN)).cast("int") + 1
        head = F.slice(F.sort_array(F.transform(tokens, ranked)), F.lit(1), length)
        return F.struct(F.xxhash64(F.sort_array(tokens)).alias("key"), size.alias("s"), head.alias("head"))

    rows = lines.select(*PLACE, tokens_of(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select(*PLACE, bind(F.col("tokens"), classed).alias("x")).select(*PLACE, "x.*")


def _possible():
    """Length and positional bound of a pair that shares a token, at1 and at2 places before it in each set."""
    need = F.ceil((F.col("s") + F.col("s2")) * F.lit(NUM) / F.lit(NUM + DEN))
    room = F.least(F.col("s") - F.col("at"), F.col("s2") - F.col("at2"))
    length = F.least("s", "s2") * DEN >= F.greatest("s", "s2") * NUM
    return length & (room >= need)


def _bits_for(rows):
    """Bits of a table for so many rows, a power of two."""
    return min(MAX_BITS, 1 << max(20, (32 * rows).bit_length()))


def _bit(value, bits):
    return F.xxhash64(value).bitwiseAND(F.lit(bits - 1)).cast("int")


def _bit_table(bits):
    """Bits of a column ``bit`` as a table: a row for 512 of them, eight numbers, at most MAX_BITS / 512 rows."""
    words = [F.bit_or(F.expr(f"if((bit >> 6) & 7 = {w}, shiftleft(1L, bit & 63), 0L)")).alias(f"w{w}") for w in range(8)]
    return bits.groupBy(F.expr("bit >> 9").alias("piece")).agg(*words)


def _listed(df, bit, table):
    """The rows of ``df`` whose ``bit`` is in the table, which is broadcast."""
    rows = df.withColumn("bit", bit).withColumn("piece", F.expr("bit >> 9")).join(F.broadcast(table), "piece")
    word = "case (bit >> 6) & 7 " + " ".join(f"when {w} then w{w}" for w in range(8)) + " end"
    return rows.where(F.expr(f"shiftright({word}, bit & 63) & 1L = 1L")).select(*df.columns)


def _verified(pairs, lines):
    """The places of the later classes of similar pairs (place, place2)."""
    sides = [F.struct(F.lit(i).alias("side"), F.col(c).alias("of")) for i, c in enumerate(("place", "place2"))]
    needs = pairs.select("place", "place2", F.inline(F.array(*sides)))
    places = needs.select("of").distinct()
    bit = _bit(F.col("of"), _bits_for(places.count()))
    table = _bit_table(places.select(bit.alias("bit")))
    chosen = _listed(lines.select(F.struct(*PLACE).alias("of"), "line"), bit, table)
    # rows that repeat are one document
    sets = chosen.select("of", tokens_of(F.col("line")).alias("tokens")).groupBy("of").agg(F.first("tokens").alias("tokens"))
    sets = stage(sets, "line-sets")
    side = [F.first(F.when(F.col("side") == i, F.col("tokens")), ignorenulls=True).alias(c) for i, c in enumerate("xy")]
    both = needs.join(sets.hint("merge"), "of").groupBy("place", "place2").agg(*side)
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - F.col("shared")
    similar = both.withColumn("shared", shared).where(F.col("shared") * DEN >= union * NUM).select("place").distinct()
    similar = stage(similar, "line-gone")
    discard(sets)
    return similar


def similar_lines(df, id_col="doc_id", text_col="text"):
    """Per line with words doc_id, th, line_no, n_tokens and kept."""
    lines = lines_of(documents(df, id_col, text_col))
    classed = stage(_classed(lines, _rarity(lines)), "lines")
    place = F.struct(*PLACE).alias("place")

    # only entries of tokens that more than one line has go on; a class is known by its earliest place
    entries = classed.select("key", "s", place, F.posexplode("head").alias("at", "token"))
    bit = _bit(F.col("token").bitwiseAND(F.lit((1 << 40) - 1)), _bits_for(classed.count()))
    # 40 bits of a token, which take less room in the shuffle and rarely fall together
    held = entries.groupBy(F.col("token").bitwiseAND(F.lit((1 << 40) - 1)).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    table = stage(_bit_table(held.where("n > 1").select(bit.alias("bit"))), "line-bits")
    entries = _listed(entries, bit, table).groupBy("token", "key").agg(
        F.min("place").alias("place"), F.first("s").alias("s"), F.min("at").alias("at")
    )
    entries = stage(entries.drop("key"), "line-entries")
    rows = stage(classed.select("key", "s", place), "line-rows")
    discard(classed, table)

    earliest = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "s", "at")).alias("p"))
    # the entries of shared tokens, with the earliest class of the token's list, which has no earlier one there
    shared = entries.join(earliest.where("n > 1").drop("n").hint("merge"), "token").where(F.col("place") != F.col("p.place"))
    shared = stage(shared, "line-lists")
    first = shared.withColumn("s2", F.col("p.s")).withColumn("at2", F.col("p.at")).where(_possible())
    # one partner each: the earliest class that most of its lists name
    votes = first.groupBy("place", F.col("p.place").alias("place2")).agg(F.count(F.lit(1)).alias("n"))
    star = votes.groupBy("place").agg(F.max(F.struct("n", "place2")).alias("m")).select("place", F.col("m.place2").alias("place2"))
    star = stage(star, "line-pairs")
    gone = _verified(star, lines)

    still = shared.drop("p").join(gone, "place", "left_anti")
    other = entries.select("token", F.col("place").alias("place2"), F.col("s").alias("s2"), F.col("at").alias("at2"))
    rest = still.join(other, "token").where(F.col("place2") < F.col("place")).where(_possible())
    rest = stage(rest.select("place", "place2").distinct().join(star, ["place", "place2"], "left_anti"), "line-pairs")
    discard(entries, shared, star)
    gone = gone.union(_verified(rest, lines))
    discard(rest)

    # the earliest line of a class that stays is the only line of it that does; rows that repeat fall together
    firsts = rows.groupBy("key").agg(F.min("place").alias("place"))
    stays = firsts.select("place").join(gone, "place", "left_anti").withColumn("stays", F.lit(True))
    joined = rows.groupBy("place").agg(F.first("s").alias("n_tokens")).join(stays, "place", "left")
    return joined.select(
        "place.doc_id", "place.th", "place.line_no", "n_tokens", F.coalesce("stays", F.lit(False)).alias("kept")
    )


def without_similar_lines(df, id_col="doc_id", text_col="text"):
    """Per document doc_id and its text without the lines that go."""
    docs = documents(df, id_col, text_col).distinct()
    gone = similar_lines(df, id_col, text_col).where(~F.col("kept"))
    # one list a document, as long as its text has lines
    gone = gone.groupBy(F.struct("doc_id", "th").alias("of")).agg(F.collect_list("line_no").alias("gone"))
    joined = docs.join(gone, F.struct("doc_id", "th") == F.col("of"), "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    )
    return joined.select("doc_id", left.alias("text"))
