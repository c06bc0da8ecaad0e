"""Registered queries of this package: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    lang_mix,
    ngram_join,
    packing,
    quality,
    secrets,
    token_counts,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from promolift.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by rules and block list (``url_filter``)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, url_filter.RULES, url_filter.spam_hosts(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside one fold of three (``lang_mix``)."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(lang_mix.fold("doc_id", 3) == 1, F.lit(False))
    model = lang_mix.train(docs.where(~held_out))
    return lang_mix.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside one fold of five (``toxicity``)."""
    docs = table(spark, sf_dir, "documents")
    fold = lang_mix.fold("doc_id", 5)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold != 0, wide=True)
    return toxicity.score(docs, model, wide=True).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_hits"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document with corpus-wide ownership (``secrets``)."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back (``warc``)."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every document under the current policy (``quality``)."""
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "rule_bits")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five-word Jaccard similarity 0.8 (``ngram_join``)."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document (``exact_dedup``)."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every text encoded and decoded (``bpe``)."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path or bpe.tokenizer_path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents packed into sequences of 4096 tokens (``packing``)."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), path or bpe.tokenizer_path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every embedding, from a covariance by polarisation (``whitening``)."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document, proven whole tokens counted directly (``token_counts``)."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path or bpe.tokenizer_path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding against all others (``hard_negatives``)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_mixture": op2_language_mixture,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
}
