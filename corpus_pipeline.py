"""Corpus pipeline: each stage works on all documents that the one before it kept."""

from troughline.llm import stages

STAGES = stages.STAGES

ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to ``documents``, each written as Parquet and read again by the next."""
    return stages.run(spark, sf_dir, STAGES)
