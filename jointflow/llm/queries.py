"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointflow.llm import (
    bpe,
    decontamination,
    filter_audit,
    fingerprint,
    license_scan,
    lm_scoring,
    merkle_manifest,
    ngram_join,
    pii,
    sharding,
    token_output,
    topk_search,
    toxicity,
)
from jointflow.llm.common import crc_mod
from jointflow.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs.withColumn("held_out", crc_mod("doc_id", 7) == 2))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Shards of the query; a cluster names its own.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "token-ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_output.read_tokens(spark, path, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[count(name).alias(f"n_{name}") for name in base],
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(pii.digest(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.add_toxicity(docs, docs, labels)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_lm_scoring,
        op3_topk_search,
        op4_byte_bpe,
        op5_sharding,
        op6_ngram_jaccard,
        op7_simple8b,
        op8_pii,
        op9_decontamination,
        op10_toxicity,
        op11_fingerprint,
        op12_merkle_manifest,
        op13_filter_audit,
    )
}
ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op3_topk_search": topk_search.oracle(5, "vec_id % 50 = 0"),
    "op8_pii": pii.oracle(),
    "op12_merkle_manifest": merkle_manifest.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
