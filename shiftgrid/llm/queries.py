"""One query per operator over the whole table it is meant for, with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftgrid.llm import (
    centroids, decontaminate, html_text, language_id, merkle, ngram_join, oracles, piece_bpe, quality_rules, secrets, substring_dedup,
    suffix_dedup, toxicity, word_bpe,
)
from shiftgrid.llm.common import held_out

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> str:
    """The public BPE model of the contract."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


@query("op2_html_text")
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.fit(pages), ["page_id", "url"])


@query("op3_piece_bpe")
def op3_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.encoded(table(spark, folder, "documents"), ["doc_id"], piece_model(), ids=False)


@query("op4_secrets")
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"), ["doc_id"])
    base = F.filter("parts", lambda p: p["strong"])
    return found.select(
        "doc_id", *[secrets.of_kind(F.col("parts"), k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("parts")).alias("spans"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scorer = toxicity.fit(docs, table(spark, folder, "labels"), learn=~held_out("doc_id"))
    out = toxicity.score(docs, scorer, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "sentences")


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = decontaminate.find(docs, table(spark, folder, "benchmark"), ["doc_id"])
    return found.withColumn("n_hit", decontaminate.n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.identify(docs, language_id.fit(docs, ~held_out("doc_id")), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, folder, "labels")), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def word_model() -> str:
    """The public word-end BPE vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_word_bpe")
def op11_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return word_bpe.encoded(table(spark, folder, "documents"), ["doc_id"], word_model(), ids=False)


@query("op12_merkle_manifest", sql=oracles.merkle())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = merkle.leaf_of(*(row | {"text": F.translate("text", *oracles.LOWER)}).values())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    proofs = merkle.manifest(docs, "lang", "doc_id", merkle.leaf_of(*row.values()), {"tampered": tampered})
    refolded = proofs.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return refolded.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_centroids", sql=oracles.lloyd())
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    members, clusters = centroids.cluster(table(spark, folder, "embeddings"))
    every = Window.partitionBy(F.lit(0))  # k rows
    named = clusters.select(
        "cluster", F.col("inertia").alias("cluster_inertia"), F.sum("inertia").over(every).alias("inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
    return members.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
