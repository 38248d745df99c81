"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secrets, encoding.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the docs of the next one. ``run`` applies them all to the table ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shiftgrid.llm import decontaminate, ngram_join, piece_bpe, quality_rules, queries, secrets  # noqa: E402
from shiftgrid.session import cut  # noqa: E402


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the learned decision list reject go."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return quality_rules.judge(packed, rules, ["_doc"], "_text").where("kept").select("_doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in shingles of five words, the one with the smallest id stays."""
    return ngram_join.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    found = decontaminate.find(packed, benchmark, ["_doc"], "_text")
    return found.withColumn("n_hit", decontaminate.n_hit()).where(~decontaminate.contaminated()).select("_doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported part of a secret is replaced by a mark; n_chars follows."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    found = secrets.scan(packed, ["_doc"], "_text").withColumn("_clean", secrets.redacted(F.col("_doc.text"), F.col("parts")))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns} | {"text": F.col("_clean")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("parts") > 0, F.length("_clean")).otherwise(out["n_chars"])
    return found.select(*[out[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    return piece_bpe.encoded(docs, ["doc_id"], queries.piece_model())


STAGES = [
    ("quality rules", by_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", encoded),
]

# No SQL: the learned list, the similarity join and the tokenizer cannot be written in it; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
