"""One registered query for each operator, over its whole table, and the SQL that checks it."""

from pyspark.sql import functions as F

from troughline.llm import (
    bpe,
    decontamination,
    exact_dedup,
    jaccard_join,
    line_dedup,
    pii,
    prefix_trie,
    quality,
    ranked_search,
    sharding,
    suffix_dedup,
    token_counts,
    token_output,
)


def tokenizer_path(name):
    """Place of a public vocabulary file; the files are never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_suffix_dedup(spark, folder):
    return suffix_dedup.repeated_passages(read(spark, folder, "documents")).drop("th")


def op2_token_output(spark, folder):
    path = token_output.token_store(
        read(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2
    )
    return token_output.token_digests(spark, path)


def op3_jaccard_join(spark, folder):
    rows = jaccard_join.near_duplicates(read(spark, folder, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op4_sharding(spark, folder):
    rows = sharding.interleave(read(spark, folder, "documents"), shards=24, seed=17)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


OP4_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), rows AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5(concat('17:', doc_id)) AS draw FROM documents
), hashed AS (
  SELECT doc_id, source, draw, CAST(strlen(text) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM rows, crc_table
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) - 0.5::DOUBLE)
    / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source, draw, doc_id) - 1 AS place, count(*) OVER () AS total
  FROM ranked
), cut AS (
  SELECT *, place * 24 // total AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, source
FROM cut
"""


def op5_line_dedup(spark, folder):
    return line_dedup.similar_lines(read(spark, folder, "documents")).drop("th")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), words AS (
  SELECT doc_id, line_no, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines
), sets AS (
  SELECT doc_id, line_no, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS t
  FROM words WHERE len(w) > 0
), classes AS (
  SELECT row_number() OVER () AS c, t, place FROM (SELECT t, min((doc_id, line_no)) AS place FROM sets GROUP BY t)
), tokens AS (
  SELECT c, unnest(t) AS token FROM classes
), shared AS (
  SELECT a.c AS c, b.c AS d, count(*) AS n FROM tokens a JOIN tokens b ON a.token = b.token AND a.c <> b.c GROUP BY ALL
), gone AS (
  SELECT DISTINCT x.c FROM shared JOIN classes x ON shared.c = x.c JOIN classes y ON shared.d = y.c
  WHERE y.place < x.place AND 100 * n >= 80 * (len(x.t) + len(y.t) - n)
)
SELECT sets.doc_id, CAST(sets.line_no AS INTEGER) AS line_no, CAST(len(sets.t) AS INTEGER) AS n_tokens,
  (sets.doc_id, sets.line_no) = classes.place AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.c = classes.c) AS kept
FROM sets JOIN classes USING (t)
"""


def op6_exact_dedup(spark, folder):
    rows = exact_dedup.exact_groups(read(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("dedup_keep_id").alias("keep_id"),
        F.col("dedup_size").alias("group_size"),
        F.col("dedup_kept").alias("kept"),
        F.col("dedup_sha256").alias("text_sha256"),
    )


OP6_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
WINDOW same AS (PARTITION BY text_sha256)
"""


def op7_bpe(spark, folder):
    return bpe.encode_documents(
        read(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), tokens=False
    )


def op8_decontamination(spark, folder):
    rows = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, n FROM doc_windows JOIN windows USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_quality(spark, folder):
    docs = read(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, read(spark, folder, "labels")))


def op10_pii(spark, folder):
    docs = read(spark, folder, "documents")
    rows = pii.span_strings(pii.find(docs, pii.fit(docs)))
    return rows.select(
        "doc_id",
        *[F.size(F.col("base")[kind]).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join("base_list", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base_list", "added_list"), ",").alias("spans"),
        F.size("added_list").cast("long").alias("n_added"),
    )


def op11_token_counts(spark, folder):
    path = tokenizer_path("piece_bpe_32k.model")
    return token_counts.count_tokens(read(spark, folder, "documents"), path, limit=4096)


def op12_ranked_search(spark, folder):
    return ranked_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=20)


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), totals AS (
  SELECT count(*) AS docs_n, CAST(sum(len(w)) AS BIGINT) AS terms_n FROM docs WHERE len(w) > 0
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term, docs_n
), lengths AS (
  SELECT doc_id, 75 + (25 * len(w) * docs_n) // terms_n AS m FROM docs, totals WHERE len(w) > 0
), scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_prefix_trie(spark, folder):
    turns, convs = prefix_trie.rebuilt(
        read(spark, folder, "conversations"), base="conv - conv % 100", shared="crc32(cast(conv as string)) % 6", most=5
    )
    return prefix_trie.prefix_trie(turns, convs)


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), convs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM convs, crc_table
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:CAST(a.h AS INTEGER)], []), a.turns[CAST(a.h AS INTEGER) + 1:]) AS turns
  FROM heads a LEFT JOIN heads b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth > 0 THEN length(any_value(turns[depth]).t) ELSE 0 END AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM (SELECT conv_id, turns, depth, turns[1:depth] AS key FROM prefixes) GROUP BY depth, key
), named AS (
  SELECT nodes.*, up.conv_id AS parent_conv_id FROM nodes LEFT JOIN nodes up
    ON up.depth = nodes.depth - 1 AND up.key = nodes.key[1:nodes.depth - 1]
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
  FROM named WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT up.conv_id, up.depth, sum((down.n_convs - 1) * down.chars) AS saved_tokens,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM children c WHERE c.conv_id = down.conv_id AND c.depth = down.depth)) AS n_leaves
  FROM named up JOIN named down ON down.depth >= up.depth AND down.key[1:up.depth] = up.key GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM named JOIN below USING (conv_id, depth) LEFT JOIN children USING (conv_id, depth)
"""


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_output": op2_token_output,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_token_counts": op11_token_counts,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op4_sharding": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_decontamination": OP8_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
