"""Ranked search against a plain version that scores every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from troughline.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score), every document scored by itself."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    total = sum(n for _, _, n in bags)
    df = Counter(term for _, bag, _ in bags for term in bag)
    w = {term: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * n + 1))) for term, n in df.items()}
    found = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for i, bag, n in bags:
            m = 75 + (25 * n * len(bags)) // total
            score = sum(w[t] * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, found))


def mine(spark, docs, items, k):
    rows = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=k)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(str(tuple(r)) for r in rows.collect())


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [rng.choice("aBé한") + str(rng.randint(0, words)) for _ in range(words)]
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary[: rng.choice([3, words])]) for _ in range(rng.randint(0, 30)))
             for _ in range(n)]
    return rng, texts


def test_many_ties_and_copies(spark):
    rng, texts = corpus(1, 80, 12)
    docs = [(i, rng.choice(texts)) for i in rng.sample(range(10_000), 400)]
    docs += [(20_000 + i, "x1 x2 x3") for i in range(60)] + [(5, None), (6, ""), (7, " .,"), (8, "B1"), (8, "B1"), (None, "x1 x2 x3")]
    items = [(i, rng.choice(texts)) for i in range(30)] + [(90, "X1 x1 x9"), (91, None), (92, ""), (93, "nowhere"), (None, "x2"),
                                                          (94, "x3"), (94, "x3"), (95, "b1"), (95, "x1")]
    for k in (1, 3, 20):
        assert mine(spark, docs, items, k) == plain(docs, items, k)


def test_blocks_and_pruning(spark, monkeypatch):
    """Many blocks of items, tables of few classes, and candidates dropped early give the same rows."""
    rng, texts = corpus(2, 500, 40)
    docs, items = list(enumerate(texts)), [(i, rng.choice(texts)) for i in range(25)]
    want = plain(docs, items, 5)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 700)
    monkeypatch.setattr(ranked_search, "HELD_SCORES", 60)
    monkeypatch.setattr(ranked_search, "HELD_CANDIDATES", 7)
    assert mine(spark, docs, items, 5) == want


def test_very_long_texts(spark):
    docs = [(1, "word " * 300_000 + "rare"), (2, "rare"), (3, "x" * 2_000_000), (4, "word word")]
    items = [(1, "rare word"), (2, "word " * 50_000), (3, "x" * 2_000_000)]
    assert mine(spark, docs, items, 20) == plain(docs, items, 20)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "b", None, None)], "doc_id int, text string, m string, item_id int")
    items = spark.createDataFrame([(7, "b", 1)], "item_id int, text string, doc_id int")
    rows = ranked_search.search(docs, items, k=20).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in rows) == [(7, 1, 2), (7, 2, 1)]
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "  ")], DOCS)
    assert ranked_search.search(nothing, items).collect() == []


def test_equal_hashes_are_refused(monkeypatch):
    monkeypatch.setattr(ranked_search.wordscan, "_hashes", lambda data, starts, ends, fold: starts.astype("u8") * 0)
    with pytest.raises(RuntimeError):
        ranked_search.ItemBlock([(0, ["a", "b"])])
