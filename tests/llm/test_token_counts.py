"""Token counts against the sentencepiece library and a plain merge loop."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from conftest import SMALL
from troughline.llm import queries, token_counts
from troughline.llm.base import read_file

PATH = queries.tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "▁", "é", "é", "😀", "1", "2", "<s>", "</s>", "<unk>", "<0x0A>", "\r", "\r\n",
         "\t", "한", "http", "://", "{", "    ", "\x00", "\x7f", "ing", "ğ", "\U000e0041", "ﬁ", "　", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(read_file(PATH))


def column(counter, texts):
    return np.concatenate([*counter.count_column(pa.array(texts, pa.string()))]).tolist()


def test_generated_texts(library, counter):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert column(counter, texts) == [len(ids) for ids in library.encode(texts, num_threads=1)]


def test_very_long_texts(library, counter):
    texts = ["x" * 200_000, "ab " * 100_000, "\n" * 5000, " " * 70_001, "é한" * 40_000, "1" * 3000, "", None]
    assert column(counter, texts) == [len(ids) for ids in library.encode([t or "" for t in texts], num_threads=1)]


def test_a_full_table_starts_anew(library):
    counter = token_counts.PieceCounter(read_file(PATH))
    counter.table.limit = 3
    texts = ["one two three", "four five", "one five", "six seven eight one"]
    for text in texts:
        assert column(counter, [text]) == [len(library.encode(text))]


def test_merges_by_a_plain_loop(counter):
    """The leftmost pair of the best score is joined until none is left."""
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("thea ing") for _ in range(rng.randint(1, 25)))
        symbols = list(text.replace(" ", token_counts.BLANK))
        while True:
            pairs = [(-counter.scores[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in counter.scores]
            if not pairs:
                break
            _, k = min(pairs)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        assert counter.count(text) == len(symbols)


def test_defined_cases(spark, library):
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "c", 1, None), (2, None, None, "y"), (3, "", 0, ""), (4, " ", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes string")
    got = token_counts.count_tokens(df, PATH, limit=1).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 1) for i, t, _, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(df.limit(0), PATH, limit=1).collect() == []


def test_other_models_are_refused(spark, tmp_path):
    bad = tmp_path / "bad.model"
    bad.write_bytes(b"\x12\x02\x18\x01")  # a trainer of another model type
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), bad, limit=1)


def test_query(spark, library):
    rows = queries.QUERIES["op11_token_counts"](spark, SMALL).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
