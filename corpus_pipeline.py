"""The corpus pipeline: quality rules, SimHash near-duplicates, benchmark
decontamination, secret scan, BPE encoding.

Each stage reads what the one before it has written.  Documents that the
quality rules reject go, and the others lose their failing lines; one document of
each near-duplicate group stays; contaminated documents go; secrets are masked in
the text (``n_chars`` follows whatever shortens it); the last stage returns the
token ids.  Stages keep extra columns, and treat null, empty and very long texts,
ties and repeated rows as their operators define; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import queries as q
from siftwork.llm.common import shared_path

STAGES = [
    ("quality_rules", q.stage_quality),
    ("simhash_near_dedup", q.stage_simhash),
    ("benchmark_decontamination", q.stage_decontaminate),
    ("secret_scans", q.stage_secrets),
    ("bpe_encoding", q.stage_bpe),
]

# fingerprints, components and BPE are beyond SQL: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
