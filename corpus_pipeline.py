"""From raw documents to token ids: drop toxic texts, near-duplicates and benchmark leaks, mask personal data, encode.

``STAGES`` are (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; each is written to
the shared folder and read again as the next one's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import jointflow
from jointflow.llm import bpe, decontamination, ngram_join, pii, toxicity
from jointflow.session import written

# Functions sent to Python workers travel with the job, so workers need no copy of this folder.
cloudpickle.register_pickle_by_value(jointflow)


def _packed(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns in one: no column that a stage adds can take the place of another."""
    return docs.select("text", F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"))


def _unpacked(made: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again, in their order; ``changed`` ones take the place of the old."""
    place = {c: F.col("own")[c] for c in docs.columns} | {"text": F.col("text")} | (changed or {})
    return made.select(*[place[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.add_toxicity(_packed(docs), docs.select("doc_id", "text"), labels)
    return _unpacked(scored.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words changed, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _unpacked(decontamination.mark_leaks(_packed(docs), items).where("not leaked"), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; ``n_chars`` follows where a text has changed."""
    masked = pii.redact(pii.find_spans(_packed(docs)))
    changed = {}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        changed["n_chars"] = F.when(F.size("spans") > 0, size).otherwise(F.col("own")["n_chars"])
    return _unpacked(masked, docs, changed)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each text, and whether they decode to the text."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "n_tokens", "ids", whole.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_personal_data),
    ("byte-level BPE", encode_bytes),
]

#: The toxicity model and the token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
