"""Generated cases against brute force, and the defined cases of every operator."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import plain_text
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from troughline.llm import (
    base,
    bitfilter,
    bpe,
    components,
    decontamination,
    exact_dedup,
    jaccard_join,
    line_dedup,
    piecetable,
    pii,
    quality,
    queries,
    sharding,
    stages,
    suffix_dedup,
    token_output,
    wordscan,
)

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"
COLUMNS = "doc_id long, text string"


def families(seed):
    """Small and large near copies, a passage that many texts share, ties, and empty texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        n = rng.choice([1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 40, 90])
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n)]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words[rng.randrange(n)] = rng.choice("klmnop") * 2
            if rng.random() < 0.3:
                words += [rng.choice("xyz")] * rng.randint(0, 2)
            texts.append(" ".join(words))
    shared = " ".join(f"common{k}" for k in range(60))
    texts += [" ".join(f"u{i}_{j}" for j in range(rng.randint(5, 80))) + " " + shared for i in range(40)]
    texts += ["", None, "   ", "a", "A", "word " * 30, "word " * 40]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_jaccard_families(spark):
    docs = families(11)
    rows = jaccard_join.near_duplicates(spark.createDataFrame(docs, COLUMNS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_text.components(docs)


def test_one_near_copy_of_a_group_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, words), (1, words + " x"), (2, words + " y"), (None, other), (None, other + " x"), (3, "alone here"), (4, "")]
    left = stages.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "4", "None"]


def near_copy_group(seed, copies=70):
    """A text, near copies of it of which some are too far from it and from each other, and short ones of its words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words)]
    for _ in range(copies):
        copy = list(words)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = "edit" + rng.choice("abcd")
        texts.append(" ".join(copy))
    texts += [" ".join(words[k : k + 70]) for k in range(0, 50, 10)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_group_of_near_copies_takes_few_rounds(spark, monkeypatch):
    rounds, stage = [], jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: (rounds.append(name), stage(df, name))[1])
    docs = near_copy_group(5)
    rows = jaccard_join.near_duplicates(spark.createDataFrame(docs, COLUMNS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_text.components(docs)
    assert rounds.count("candidates") <= 2


def test_odd_bitmaps_refuse_no_similar_pair():
    rng = np.random.default_rng(8)
    rows, similar = [], []
    for k in range(400):
        both = rng.integers(0, 1 << 63, rng.integers(1, 3000), dtype=np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 1 << 63, len(both) * rng.integers(0, 30) // 100, dtype=np.uint64)]) for _ in "xy")
        shared = len(np.intersect1d(x, y))
        similar.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        rows.append((str(k).encode(), b"", b"", b"", len(x), len(y), jaccard_join._odd(x), jaccard_join._odd(y)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in zip(*rows)], names=["a", "b", "root_a", "root_b", "n", "m", "x", "y"]
    )
    (kept,) = jaccard_join._within([batch])
    kept = {int(a) for a in kept.column("a").to_pylist()}
    assert {k for k, s in enumerate(similar) if s} <= kept and len(kept) < 400


def test_a_filter_is_read_in_few_jobs(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.sparkContext.setJobGroup("filter", "filter")
        known = bitfilter.build(spark.range(1000), 1000)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert known.value.has(np.arange(1000)).all() and 0 < len(jobs) <= 3


def test_signatures_release_the_encoders_of_a_worker():
    bpe._loaded["kept"] = token_output._loaded["kept"] = object()
    assert not list(jaccard_join._signatures(wordscan.SPACED, 5)(iter([])))
    assert not bpe._loaded and not token_output._loaded


def test_tables_of_an_encoder_are_small():
    assert bpe.REMEMBERED * (24 + piecetable.PIECE_BYTES) + bpe.REMEMBERED_WORDS * 400 < 60 << 20
    table = piecetable.PieceTable([np.dtype(np.uint8)], 1000)
    for k in range(40):
        keys = np.arange(10, dtype=np.uint64) + np.uint64(10 * k)
        starts, lengths = table.look(keys, lambda at: ((np.full(10_000, k, dtype=np.uint8), np.full(len(at), 1000)),))
        assert (piecetable.gather(table.values[0], starts[0], lengths[0]) == k).all()
        assert len(table.values[0]) <= 1000 * piecetable.PIECE_BYTES + 10_000


def test_unused_memory_is_given_back():
    def resident():
        with open("/proc/self/statm") as handle:
            return int(handle.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    before = resident()
    blocks = [bytearray(50_000) for _ in range(4000)]
    held, last = resident() - before, blocks.pop()  # the last one keeps the heap from shrinking by itself
    del blocks
    base.trim()
    assert held > 150 << 20 and resident() - before < held // 4 and len(last) == 50_000


def test_subset_sizes_decide():
    for s in range(1, 13):
        for t in range(1, 13):
            for shared in range(min(s, t) + 1):
                similar = 100 * shared >= 80 * (s + t - shared)
                assert similar == (shared >= jaccard_join.needed(s, t))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    links += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    rows = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert {r.node: r.root for r in rows} == {x: root(x) for x in parent}


def test_copies_are_not_expanded_to_passages(spark, monkeypatch):
    words = [f"w{k}" for k in range(2000)]
    docs = [(k, " ".join(words)) for k in range(20)] + [(99, " ".join([*words[:300], "new", *words[300:]]))]
    staged = {}

    def counted(df, name):
        staged[name] = base.stage(df, name)
        return staged[name]

    monkeypatch.setattr(suffix_dedup, "stage", counted)
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(docs, COLUMNS)).collect()
    assert sorted((r.doc_id, r.begin, r.end, r.first_doc, r.later) for r in rows if r.doc_id in (0, 1, 99)) == [
        (0, 0, 2000, 0, False), (1, 0, 2000, 0, True), (99, 0, 300, 0, True), (99, 301, 2001, 0, True)]
    # 41,000 passages; those around the new word alone are told apart one by one
    assert len(rows) == 22 and sum(df.count() for df in staged.values()) < 10_000


@pytest.mark.parametrize("length,shingle", [(20, 5), (7, 7)])
def test_passages(spark, length, shingle):
    rng = random.Random(length)
    known = [[f"p{i}_{j}" for j in range(70)] for i in range(6)]
    docs = []
    for i in range(100):
        words = [rng.choice("abc") if rng.random() < 0.5 else f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            begin = rng.randint(0, 30)
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(known)[begin : rng.randint(begin + 5, 70)]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(200, "a " * 300), (201, "a " * 200), (202, ""), (203, None), (204, "b " * 100)]
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(docs, COLUMNS), min_words=length, shingle=shingle).collect()
    assert {(r.doc_id, r.begin, r.end, r.later) for r in rows} == plain_text.passages(docs, length)


def test_passages_are_cut_from_later_documents(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = [(1, f"x {passage} y"), (2, f"zz {passage}  q"), (3, "clean")]
    rows = suffix_dedup.without_repeats(spark.createDataFrame(docs, COLUMNS)).collect()
    assert {r.doc_id: r.text for r in rows} == {1: f"x {passage} y", 2: "zz   q", 3: "clean"}


def test_contamination_of_short_and_repeated_items(spark):
    rng = random.Random(3)
    words = ["a", "b", "é9", "C"]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 7, 10, 14])))) for k in range(25)]
    items += [("i1", "b b b"), ("n", None)]
    docs = [(k, " - ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(99, None)]
    rows = decontamination.contamination(
        spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == plain_text.contamination(docs, items)


def test_an_item_without_an_id_hits_and_is_not_listed(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one")], COLUMNS)
    items = spark.createDataFrame([(None, "two three"), (7, "one")], "item_id long, text string")
    rows = decontamination.contamination(docs, items).collect()
    assert {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in rows} == {1: (3, ["7"], True), 2: (1, ["7"], True)}


def test_query_of_documents_with_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b", 5, "x"), (2, "a b", None, "y")], COLUMNS + ", dedup_keep_id long, DEDUP_kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op6_exact_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == [(1, 1, 2, True), (2, 1, 2, False)]


def test_line_oracle_splits_at_the_same_white_space(spark, tmp_path):
    import duckdb

    text = "one two three four five six\r\none\ttwo\x0bthree\x0cfour five\r six\n\r\nseven eight"
    docs = spark.createDataFrame([(1, text), (2, text.replace("\r", ""))], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    truth = con.execute(f"select doc_id, line_no, n_tokens, kept from ({queries.OP5_SQL})").fetchall()
    mine = queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).select("doc_id", "line_no", "n_tokens", "kept").collect()
    assert sorted(map(tuple, mine)) == sorted(truth) and len(truth) == 6


def test_personal_data_in_odd_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", "c-d", ".", "1", "22", "+1", "(", ")", " ", "-", "é", "😀", "\n", "10.0.0.1", "255", "256",
             "4652288524086166", "a@b.co", "+1 (737) 555-3887", "000", "_", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["", None, "a" * 30000, "1" * 30000, "1." * 20000, "a@" + "b." * 20000 + "c", "a@b.c " * 2000, "1 " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), COLUMNS)
    rows = pii.span_strings(pii.find(df, pii.CandidateModel("0D", {}))).select("doc_id", "base_list").collect()
    for row in rows:
        assert row.base_list == plain_text.base_spans(texts[row.doc_id] or "")


def test_added_spans_touch_no_base_span(spark):
    text = "call (737) 555-3887 or +1 (737) 555-3887, mail a (at) b.co"
    model = pii.CandidateModel("5D", {"number": 0.5, "address": 0.5})
    row = pii.redact(pii.find(spark.createDataFrame([(1, text)], COLUMNS), model)).first()
    assert row.redacted == "call [number] or [phone], mail [address]"


def planted(count=240):
    """Texts with base hits, personal data written in other ways, and clean numbers; what is to be added."""
    rng, texts, want = random.Random(8), [], {}
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    fill = lambda: " ".join(rng.choice(["there", "was", "a", "long", "road", "to", "it"]) for _ in range(6))
    for k in range(count):
        a, b, c, name = digits(3), digits(3), digits(4), f"ann.{digits(2)}"
        base = rng.choice([f"{name}@mail{k % 5}.example.com", f"+1 ({a}) {b}-{c}", f"10.{k % 200}.7.1", "4652288524086166"])
        added = [f"{name} (at) mail{k % 5} (dot) example (dot) com", f"{name} @ mail.example.com", f"{name}[at]mail.example.com",
                 f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1 ({a}) {b}-{c}"][k % 6]
        clean = [f"order {digits(9)} of", f"2019-0{k % 9 + 1}-1{k % 10} then", f"look (at) this. Then {digits(5)}.{digits(4)} is",
                 f"4652288524086{digits(2)}1 was"][k % 4]
        parts = [f"{fill()} {base} {fill()}", f"{fill()} {clean} {fill()}"]
        if k % 2:
            parts.append(f"{fill()} {added} {fill()}")
            rng.shuffle(parts)
        text = "\n".join(parts)
        want[k] = {added} if k % 2 else set()
        texts.append(text)
    return texts, want


def added_texts(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), COLUMNS)
    rows = pii.find(df, model).select("doc_id", "added").collect()
    return {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.added] for r in rows}


def test_fitted_model_adds_personal_data_in_other_forms(spark):
    texts, want = planted()
    # the fourth clean number must not be a card
    want = {k: v for k, v in want.items() if not any(plain_text.luhn(x) for x in re.findall("4652288524086[0-9]{3}", texts[k])
            if x != "4652288524086166")}
    got = added_texts(spark, texts, pii.fit(spark.createDataFrame(list(enumerate(texts)), COLUMNS)))
    assert {k: set(got[k]) for k in want} == want


def test_secrets_are_added_and_other_runs_left(spark):
    rng, texts, want = random.Random(3), planted()[0], {}
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    both = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(120):
        secret = [run("0123456789abcdef", 40), run("0123456789ABCDEF", 32), run(both, 24) + "a1", run(both, 43) + "7="][k % 4]
        uuid = "-".join(run("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        name = ["token", "API_KEY", "password", "client_secret"][k % 4]
        texts.append([
            f'so {name} = "{secret}" it', f"so {name}: {secret} it", f"request {uuid} was seen",
            f"see https://example.com/articles/2024/a-long-road-to-it-{k} or conference2019proceedings",
        ][k // 4 % 4])
        want[len(texts) - 1] = [secret] if secret in texts[-1] else []
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), COLUMNS))
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), COLUMNS), model).select("doc_id", "added").collect()
    got = {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.added if x.kind == "secret"] for r in rows}
    assert "secret" in model.thresholds and {k: got[k] for k in want} == want
    odd = ["", "a1" * 30_000, "- " * 20_000, "x" * 16, "1" * 16, "token = ", 'token = "é"']
    assert set(added_texts(spark, odd, model)) == set(range(len(odd)))


def test_numbers_side_by_side_are_added_one_by_one(spark):
    texts = [f"{text} {k}x" for k, text in enumerate(planted(200)[0])]
    pair, run = "so 4465758382889437 4465758382889437 it", "so +9 (999) 999-9999 999.999.999.999 it, +1 (737) 555-3887 10.1.2.3"
    model = pii.fit(spark.createDataFrame(list(enumerate(texts + [pair] * 12)), COLUMNS))
    got = added_texts(spark, [pair, run], model)
    assert got[0] == ["4465758382889437", "4465758382889437"]
    model = pii.CandidateModel("5D", {"number": 0.5})
    got = added_texts(spark, [pair, "so +1 (737) 555-3887 217.94.102.185 it"], model)
    assert got[0] == ["4465758382889437", "4465758382889437"] and got[1] == ["+1 (737) 555-3887"]


def test_overlap_chain_keeps_what_no_kept_span_covers(spark):
    rows = [(1, [("number", 0, 10, 0.7), ("address", 8, 20, 0.8), ("number", 18, 30, 0.9), ("number", 40, 50, 0.6)])]
    df = spark.createDataFrame(rows, "doc_id long, c array<struct<kind:string,s:int,e:int,score:double>>")
    kept = df.select(pii.apart(F.col("c")).alias("kept")).first().kept
    assert sorted((x.s, x.e) for x in kept) == [(0, 10), (18, 30), (40, 50)]


def test_thresholds_count_documents_outside_the_sample(spark):
    texts = planted()[0]
    ids = spark.range(400).select(F.col("id").alias("doc_id"))
    sampled = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    plain = [t for k, t in enumerate(texts) if k % 2 == 0]
    rare = [t for k, t in enumerate(texts) if k % 6 == 1]
    rows = [(k, plain[k % len(plain)] if k in sampled else rare[k % len(rare)]) for k in range(400)]
    model = pii.fit(spark.createDataFrame(rows, COLUMNS), sample=100)
    assert "address" in model.thresholds


@pytest.mark.parametrize("module", [pii, quality], ids=["pii", "quality"])
def test_samples_are_looked_for_by_all_tasks(spark, monkeypatch, module):
    class Seen(Exception):
        pass

    def staged(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(module, "stage", staged)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], COLUMNS).repartition(9)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    with pytest.raises(Seen) as plan:
        pii.fit(docs) if module is pii else quality.train(docs, labels)
    assert "Repartition 4, false" not in str(plan.value)


def test_lines_that_end_in_crlf(spark):
    words = "one two three four five six"
    docs = [(1, f"{words}\r\nother\x0bline\r\n"), (2, f"{words}\n{words.replace(' ', chr(12))}\r\n\r\n"), (3, "other line")]
    lines = line_dedup.similar_lines(spark.createDataFrame(docs, COLUMNS)).collect()
    want = {(1, 0): (2, True), (1, 1): (1, True), (2, 0): (2, False), (2, 1): (2, False), (3, 0): (1, False)}
    assert {(r.doc_id, r.line_no): (r.n_tokens, r.kept) for r in lines} == want


def test_similar_lines_delete_their_tables_and_send_no_bits_in_plans(spark, monkeypatch):
    words = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(1, words), (2, words + " q\nx y"), (3, words.replace("a", "z")), (4, words)], COLUMNS)
    folders, plans, real = [], [], line_dedup.stage

    def staged(df, name):
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        table = real(df, name)
        folders.append(table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
        return table

    monkeypatch.setattr(line_dedup, "stage", staged)
    rows = line_dedup.similar_lines(docs)
    kept = {os.path.basename(f)[:-33] for f in folders if os.path.exists(f)}
    assert {(r.doc_id, r.line_no) for r in rows.collect() if not r.kept} == {(2, 0), (3, 0), (4, 0)}
    assert kept <= {"line-rows", "line-gone"} and max(plans) < 1_000_000


def test_library_and_word_encoders_on_odd_texts():
    from tokenizers import Tokenizer

    paths = [queries.tokenizer_path(n) for n in (BYTES, WORDS)]
    library, words = (Tokenizer.from_file(p) for p in paths)
    mine, word_bpe = (cls(open(p, "rb").read()) for cls, p in zip((token_output.LibraryEncoder, bpe.WordBpe), paths))
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", " ", "　", "a", "b's", "'ll", "é", "12", "!", "<|endoftext|>", "foo", "\x1c", "\x85",
             "​", ".", "\r\n", "   ", "ΑΣ", "İ", "x́", "Foo.", "é" * 80, "ab" * 60, "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    column = pa.array([*texts, None])
    got = []
    for ids, counts in mine.encode_column(column):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in [*texts, ""]]
    got = []
    for ids, bounds, decoded, ends in word_bpe.encode_column(column):
        got += [
            (ids[a:b].tolist(), decoded[c : max(c, d - 1)].tobytes().decode())
            for a, b, c, d in zip(bounds[:-1], bounds[1:], ends[:-1], ends[1:])
        ]
    want = [words.encode(t or "", add_special_tokens=False).ids for t in [*texts, ""]]
    assert got == [(ids, words.decode(ids, skip_special_tokens=False)) for ids in want]


def test_token_files_read_selectively(spark, tmp_path):
    docs = spark.createDataFrame([(5, "five words"), (1, "one"), (None, "none"), (3, None)], COLUMNS)
    path = token_output.token_store(docs, queries.tokenizer_path(BYTES), 2, str(tmp_path / "tokens"))
    rows = token_output.read_positions(spark, path).orderBy("start")
    assert [r.doc_id for r in rows.collect()] == [None, 1, 3, 5]
    assert "tokens:array" not in rows._jdf.queryExecution().executedPlan().toString()
    selected = token_output.read_tokens(spark, path, "doc_id > 2").orderBy("doc_id")
    assert "GreaterThan(doc_id,2)" in selected._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.tokens[-1]) for r in selected.collect()] == [(3, 2), (5, 2)]


def test_filter_never_loses_a_hash(spark):
    hashes = [(k * k * 7919,) for k in range(3000)] + [(k * k * 7919,) for k in range(0, 3000, 3)]
    df = spark.createDataFrame(hashes, "h long").repartition(5)
    every = bitfilter.build(df, 4000).value
    twice = bitfilter.build(df, 4000, twice=True).value
    assert every.has(np.array([h for (h,) in hashes])).all()
    assert twice.has(np.array([k * k * 7919 for k in range(0, 3000, 3)])).all()
    assert twice.has(np.array([k * k * 7919 for k in range(3000) if k % 3])).mean() < 0.1
    assert every.has(np.arange(1, 2000) * 104729).mean() < 0.1


def test_words_longer_than_a_chunk():
    long = "x" * (wordscan.CHUNK_BYTES + 5)
    texts = pa.array(["a " + long + " b", "B " + long.upper(), "a b"])
    rows = [wordscan.words(d, o, wordscan.SPACED)[3].tolist() for _, _, d, o in wordscan.chunks(texts)]
    (a1, x1, b1), (b2, x2), (a3, b3) = rows if len(rows) == 3 else ([], [], [])
    assert (a1, x1, b1) == (a3, x2, b3) and b1 == b2


CLASHING = "doc_id long, text string, source string, th long, c string, s int, key int, place string, loser int, stats int, " \
    "score int, chosen int, label int, dedup_kept int, part int, base int"
ROWS = [
    (1, "same text here", "x"), (1, "same text here", "x"), (None, None, None), (None, "same  text here", "x"), (2, "", None),
    (3, "a b c d e f g h i j k l", "y"), (4, "a b c d e f g h i j k l", "y"), (5, "mail a@b.co\n\nmail a@b.co", "y"),
]


def clashing(spark, rows):
    wide = [(*r, 1, "c", 2, 3, "p", 4, 5, 6, 7, 8, 9, 10, 11) for r in rows]
    return spark.createDataFrame(wide, CLASHING).repartition(3)


def benchmark(spark, rows=(("q", "c d e f"),)):
    return spark.createDataFrame(list(rows), "item_id string, text string")


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "odd"])
def test_defined_cases(spark, rows):
    df = clashing(spark, rows)
    distinct = len({r[:2] if r[1] else (r[0], "") for r in rows})

    stays = exact_dedup.exact_dedup(df).collect()
    # the two empty texts and the three spellings of one text stay with their null ids
    assert sorted(str(r.doc_id) for r in stays) == (["3", "5", "None", "None"] if rows else [])
    groups = exact_dedup.exact_groups(df)
    assert groups.count() == len(rows) and groups.where("_dedup_kept").count() == len(stays)
    assert groups.columns[: len(df.columns)] == df.columns

    placed = sharding.interleave(df, 3).collect()
    for shard in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
    assert len(placed) == len(rows)

    near = jaccard_join.near_duplicates(df).collect()
    assert len(near) == distinct
    assert all(r.component_id == 3 for r in near if r.doc_id in (3, 4))

    hit = decontamination.contamination(df, benchmark(spark)).collect()
    assert len(hit) == distinct and {r.doc_id for r in hit if r.contaminated} == ({3, 4} if rows else set())
    assert not any(r.contaminated for r in decontamination.contamination(df, benchmark(spark, [])).collect())

    assert suffix_dedup.repeated_passages(df, min_words=12, shingle=5).count() == (2 if rows else 0)
    lines = line_dedup.similar_lines(df).collect()
    assert sorted((r.doc_id, r.line_no) for r in lines if not r.kept and r.doc_id) == (
        [(1, 0), (4, 0), (5, 2)] if rows else [])
    assert line_dedup.without_similar_lines(df).count() == distinct

    encoded = bpe.encode_documents(df, queries.tokenizer_path(WORDS)).collect()
    assert len(encoded) == len(rows) and all(len(r.ids) == r.n_tokens for r in encoded)
    path = token_output.token_store(df, queries.tokenizer_path(BYTES), 2)
    digests = token_output.token_digests(spark, path).collect()
    assert len(digests) == len(rows) and all(r.n_tokens >= 1 for r in digests)

    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scored = quality.score(df, quality.train(df, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.accepted(df, quality.RuleModel(1.0, [], [])).columns == df.columns

    found = pii.span_strings(pii.find(df, pii.fit(df))).collect()
    assert len(found) == len(rows)
    assert [r.base_list for r in found if r.doc_id == 5] == ([["email:5:11", "email:18:24"]] if rows else [])

    losers = df.select(F.struct("doc_id", "s").alias("key")).where("key.doc_id is null or key.doc_id = 3")
    left = bitfilter.without_keys(df, F.struct(df["doc_id"], df["s"]), losers)
    assert left.count() == sum(r[0] not in (None, 3) for r in rows) and left.columns == df.columns


def test_shards_hold_the_mixture(spark):
    rows = [(k, f"text {k}", "hot" if k % 3 else f"s{k % 7}") for k in range(2000)]
    placed = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8, seed=5).toPandas()
    sizes = placed.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for source, group in placed.groupby("source"):
        share = group.groupby("shard").size().reindex(range(8), fill_value=0)
        # a cut falls at most one row of every source beside the source's own cut
        assert share.max() - share.min() <= placed.source.nunique()
    assert placed.text_crc32.tolist() == [zlib.crc32(f"text {k}".encode()) for k in placed.doc_id]


def test_digest_of_normalised_text(spark):
    row = exact_dedup.exact_groups(spark.createDataFrame([(1, " a\t\n b\x0b\xa0c ")], COLUMNS)).first()
    assert row.dedup_sha256 == hashlib.sha256(" a b \xa0c ".encode()).hexdigest()
