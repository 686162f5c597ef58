"""Stages of the corpus pipeline, each from (spark, docs, sf_dir) to the documents that it keeps."""

from pyspark.sql import functions as F

from troughline.llm import bitfilter, bpe, decontamination, jaccard_join, quality
from troughline.llm.base import stage
from troughline.llm.exact_dedup import exact_dedup
from troughline.llm.queries import read, tokenizer_path


def _key(docs):
    """A document's key as in ``base.documents``: its id and the hash of its text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("th"))


def drop_low_quality(spark, docs, sf_dir):
    """Quality classifier: documents that it rejects go."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    """Exact deduplication: of equal texts the row with the smallest id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Jaccard join: of each group of near duplicates the document with the smallest id stays."""
    rows = stage(jaccard_join.near_duplicates(docs), "near-duplicates")
    # ids can repeat and be null: of a group the pair of id and text hash that stays is one
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keeper_th"))
    losers = rows.where(~stays)
    return bitfilter.without_keys(docs, _key(docs), losers.select(F.struct("doc_id", "th").alias("key")))


def drop_contaminated(spark, docs, sf_dir):
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    rows = stage(decontamination.contamination(docs, read(spark, sf_dir, "benchmark")), "contamination")
    return bitfilter.without_keys(
        docs, _key(docs), rows.where("contaminated").select(F.struct("doc_id", "th").alias("key"))
    )


def encode(spark, docs, sf_dir):
    """Byte-pair encoding of every document that is left, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-pair encoding", encode),
]


def run(spark, sf_dir, stages):
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(stages):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
