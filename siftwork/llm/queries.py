"""The registered query of each operator, with the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, decontam, html, merkle, packing, quality, records, secrets, sharding, simhash, substring, urls
from .common import fresh, shared_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id"], ids=False)


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_path(spark, "records")
    records.write(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    records.write_index(spark, folder)
    return records.read(spark, folder, ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    h = F.col("hits")
    return hits.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"),
                       F.size(h["items"]).cast("long").alias("n_items"),
                       F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
                       decontam.contaminated(h).alias("contaminated"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).drop("removed")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, keep=["doc_id"])


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    of = {k: secrets.of_kind(F.col("secrets"), k) for k in secrets.BASE}
    base = secrets.of_kind(F.col("secrets"), *secrets.BASE)
    return found.select("doc_id", *[F.size(of[k]).cast("long").alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("secrets")).alias("spans"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), ids=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    row = {c: F.col(c) for c in fields}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claim = F.when(tampered, merkle.leaf(list({**row, "n_chars": F.col("n_chars") + 1}.values())))
    out = merkle.manifest(docs, merkle.leaf(list(row.values())), "lang", "doc_id", claim, keep=["doc_id"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, length="n_chars")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs.columns, "hits")
    hits = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    return hits.where(~decontam.contaminated(F.col(name))).select(*docs.columns)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length="n_chars")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), keep=keep)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_records": op2_records,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_html": op5_html,
    "op6_substring": op6_substring,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_secrets": op10_secrets,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}
