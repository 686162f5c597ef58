"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are fitted to labelled documents; every path from a root to a node is a conjunction of
threshold conditions, a rule. A logistic regression with a lasso penalty then weighs all rules and the
statistics themselves and leaves most at zero. What remains is compiled into one Spark column
expression, so that scoring is part of the scan's projection: no join, no shuffle, no model object.

Statistics come from the whole text, vectorised over Arrow batches. The labelled rows that a model is
fitted to are bounded by ``max_rows`` (those first in the order of a hash of their id); everything
else sees all rows.

Defined cases: null and empty texts have all statistics 0 and a score like any other text; labels
with a null id or null quality are left out; with labels of one class only every text gets that class's
share as its score, with no labels 0.5; rows that repeat are scored again; extra columns, whatever
their names, are left out of ``score``'s result unless named in ``keep``.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline.llm import trees as trees_of
from troughline.llm import wordscan
from troughline.llm.base import python_ready, stage

#: Labelled rows that one model is fitted to, at most.
MAX_ROWS = 20_000

#: Statistics of a text; shares are of its bytes, words, shingles or lines.
STATS = (
    "log_words", "word_length", "line_words", "upper", "digit", "mark", "symbol", "bar", "white", "wide",
    "distinct", "top_word", "same_next", "repeated_shingles", "repeated_lines", "short_words", "long_words",
    "capitalised", "sentence_ends", "marked_words", "longest_word", "entropy",
)

_UPPER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _shares(mask, offsets, sizes):
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(sizes, 1)


def text_stats(texts):
    """Statistics of an Arrow array of texts: an array with a row a text, columns as in STATS."""
    blocks = [np.zeros((0, len(STATS)))]
    for _, _, data, offsets in wordscan.chunks(texts):
        n, sizes = len(offsets) - 1, np.diff(offsets)
        starts, ends, rows, hashes = wordscan.words(data, offsets, wordscan.SPACED)
        bounds = wordscan.row_bounds(rows, n)
        counts, lengths = np.diff(bounds), ends - starts
        shingles = wordscan.grams(hashes, 5)
        lines = _line_hashes(data, offsets)
        last, first = data[ends - 1], data[starts]
        stat = {
            "log_words": np.log1p(counts),
            "word_length": _shares(np.repeat(True, len(data)), offsets, counts),
            "upper": _shares(_UPPER[data], offsets, sizes),
            "digit": _shares(_DIGIT[data], offsets, sizes),
            "mark": _shares(_MARK[data], offsets, sizes),
            "symbol": _shares(_SYMBOL[data], offsets, sizes),
            "bar": _shares(data == ord("|"), offsets, sizes),
            "white": _shares(~wordscan.SPACED[data], offsets, sizes),
            "wide": _shares(data >= 0x80, offsets, sizes),
            "short_words": _shares(lengths <= 3, bounds, counts),
            "long_words": _shares(lengths >= 10, bounds, counts),
            "capitalised": _shares(_UPPER[first], bounds, counts),
            "sentence_ends": _shares((last == ord(".")) | (last == ord("?")), bounds, counts),
            "marked_words": _shares((_MARK | _SYMBOL)[last], bounds, counts),
        }
        block = np.zeros((n, len(STATS)))
        for k, name in enumerate(STATS):
            if name in stat:
                block[:, k] = stat[name]
        at = {name: k for k, name in enumerate(STATS)}
        for row in range(n):
            lo, hi = bounds[row], bounds[row + 1]
            if lo == hi:
                continue
            m = hi - lo
            _, times = np.unique(hashes[lo:hi], return_counts=True)
            block[row, at["distinct"]] = len(times) / m
            block[row, at["top_word"]] = times.max() / m
            block[row, at["same_next"]] = np.count_nonzero(hashes[lo + 1 : hi] == hashes[lo : hi - 1]) / m
            block[row, at["longest_word"]] = np.log1p(lengths[lo:hi].max())
            if m > 5:
                block[row, at["repeated_shingles"]] = 1 - len(np.unique(shingles[lo : hi - 4])) / (m - 4)
            own = lines[row]
            block[row, at["line_words"]] = m / max(1, len(own))
            block[row, at["repeated_lines"]] = 1 - len(np.unique(own)) / max(1, len(own))
            freq = np.bincount(data[offsets[row] : offsets[row + 1]], minlength=256) / sizes[row]
            freq = freq[freq > 0]
            block[row, at["entropy"]] = -(freq * np.log2(freq)).sum()
        blocks.append(block)
    return np.concatenate(blocks)


_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _line_hashes(data, offsets):
    _, _, rows, hashes = wordscan.words(data, offsets, _LINE)
    bounds = wordscan.row_bounds(rows, len(offsets) - 1)
    return [hashes[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]


def with_stats(df, text_col="text", name="stats", keep_text=False):
    """``df`` with a struct ``name`` of doubles, without its text unless ``keep_text``."""
    python_ready(df.sparkSession)
    others = [f for f in df.schema.fields if keep_text or f.name != text_col]

    def compute(batches):
        for batch in batches:
            block = text_stats(batch.column(text_col))
            if not len(block):
                block = np.zeros((batch.num_rows, len(STATS)))
            stats = pa.StructArray.from_arrays([pa.array(block[:, k]) for k in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), stats], names=[*(f.name for f in others), name]
            )

    struct = T.StructType([T.StructField(stat, T.DoubleType()) for stat in STATS])
    return df.mapInArrow(compute, T.StructType([*others, T.StructField(name, struct)]))


class RuleModel:
    """Weighted rules and statistics; ``column`` is the score as SQL text over ``stats``."""

    def __init__(self, intercept, rules, linear):
        self.intercept, self.rules, self.linear = intercept, rules, linear

    def column(self, stats="stats"):
        terms = [f"{float(self.intercept)!r}D"]
        terms += [f"IF({rule.replace('stats.', stats + '.')}, {float(weight)!r}D, 0D)" for rule, weight in self.rules]
        terms += [f"{float(w)!r}D * {stats}.{name}" for name, w in self.linear]
        return f"1D / (1D + exp(-({' + '.join(terms)})))"


def fit(labelled, trees=8, depth=3, penalty=0.001):
    """Fit to rows of ``stats`` and ``label`` (0 or 1); the rows are bounded by the caller."""
    counts = {int(r.label): r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = {0: -12.0, 1: 12.0}.get(next(iter(counts), None), 0.0)
        return RuleModel(share, [], [])
    plain = labelled.select(F.col("label").cast("double").alias("label"), "stats.*")
    vectors = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(plain)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, subsamplingRate=0.8, seed=1).fit(vectors)
    rules = trees_of.paths(boosted.toDebugString, [f"stats.{name}" for name in STATS])
    inputs = labelled.select(
        F.col("label").cast("double").alias("label"),
        *[F.expr(f"CAST({rule} AS DOUBLE)").alias(f"r{k}") for k, rule in enumerate(rules)],
        *[F.expr(f"stats.{name}").alias(f"s{k}") for k, name in enumerate(STATS)],
    )
    names = [c for c in inputs.columns if c != "label"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(inputs).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(rows)
    weights = lasso.coefficients.toArray()
    return RuleModel(
        lasso.intercept,
        [(rule, w) for rule, w in zip(rules, weights) if w],
        [(name, w) for name, w in zip(STATS, weights[len(rules) :]) if w],
    )


def is_held_out(id_column):
    """Whether a document is kept from learning: CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def train(docs, labels, id_col="doc_id", text_col="text", max_rows=MAX_ROWS):
    """Rule model of ``labels.quality`` on at most ``max_rows`` labelled documents."""
    chosen = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.where(F.col("labelled").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("labelled")))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most ``max_rows`` ids and labels: small enough to be sent to every task
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("label", "text")
    # all tasks look for the sample; only the small staged table is read by few
    return fit(stage(with_stats(rows).select("label", "stats"), "quality-sample").coalesce(4))


def score(docs, model, id_col="doc_id", text_col="text", keep=()):
    """Per row doc_id, held_out, score, predicted and the columns in ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    scored = with_stats(rows).withColumn("score", F.expr(model.column()))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep,
    )


def accepted(docs, model, text_col="text"):
    """The rows of ``docs``, all columns, whose text the model does not reject."""
    name = "quality_stats"
    while name in docs.columns:
        name += "_"
    scored = with_stats(docs, text_col, name, keep_text=True)
    return scored.where(F.expr(model.column(name)) >= 0.5).select(*docs.columns)
