"""Registered text queries against their SQL, and the library's own encoders, on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import plain_text
import pytest

from conftest import SMALL
from troughline.llm import queries

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()


def frame(spark, name):
    return queries.QUERIES[name](spark, SMALL).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    truth = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in truth.description)
    places = [[c[0] for c in truth.description].index(c) for c in columns]
    mine = queries.QUERIES[name](spark, SMALL)
    assert sorted(mine.columns) == columns
    rows = sorted(str(tuple(r)) for r in mine.select(*columns).collect())
    assert rows == sorted(str(tuple(r[k] for k in places)) for r in truth.fetchall())


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = frame(spark, "op2_token_output").set_index("doc_id")
    start = 0
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        row = rows.loc[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(texts)


def test_word_bpe(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    rows = frame(spark, "op7_bpe").set_index("doc_id")
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        row = rows.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_near_duplicates(spark, texts):
    rows = frame(spark, "op3_jaccard_join")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.itertuples()} == plain_text.components(texts)


def test_repeated_passages(spark, texts):
    rows = frame(spark, "op1_suffix_dedup")
    assert set(zip(rows.doc_id, rows.begin, rows.end, rows.later)) == plain_text.passages(texts, 50)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").df()
    rows = queries.QUERIES["op9_quality"](spark, folder).toPandas().merge(labels, on="doc_id")
    held = rows[rows.held_out]
    assert len(held) > 50 and (held.held_out == (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1)).all()
    assert (held.predicted == held.quality).mean() > 0.97
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_personal_data(spark, texts):
    rows = frame(spark, "op10_pii").set_index("doc_id")
    for doc_id, text in texts:
        want = plain_text.base_spans(text or "")
        assert rows.loc[doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert rows.loc[doc_id].spans.startswith(",".join(want))


def test_pipeline(spark, texts):
    import corpus_pipeline
    from troughline.llm import quality
    from troughline.llm.queries import read

    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    scores = quality.score(docs, quality.train(docs, labels)).toPandas()
    kept = {i: t for i, t in texts if i in set(scores.doc_id[scores.predicted == 1])}
    seen = {}
    for i, text in sorted(kept.items()):
        seen.setdefault(plain_text.re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    kept = {i: kept[i] for i in seen.values()}
    kept = {i: kept[i] for i, (_, root) in plain_text.components(list(kept.items())).items() if i == root}
    items = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet'").fetchall()
    clean = {i for i, (_, hit, _) in plain_text.contamination(list(kept.items()), items).items() if not hit}
    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(rows.doc_id) == sorted(clean)
    assert (rows.n_tokens == rows.ids.map(len)).all()
    assert [f.__doc__ is not None for _, f in corpus_pipeline.STAGES] == [True] * 5
