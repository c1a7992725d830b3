"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, ngram_join, phrase_dedup, quality_rules, warc
from .decontaminate import benchmark_hits
from .html_density import extract_main_text
from .language_id import identify_language
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .phrase_dedup import remove_repeated_passages
from .secret_scan import scan_secrets
from .sharding import shard_documents
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public tokenizer file that the packing query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=5, percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def spans_text(spans, kinds: tuple[str, ...]):
    """Findings of the kinds as comma-joined kind:start:end."""
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = spans_text(F.col("spans"), ("assign", "access", "hex"))
    every = spans_text(F.col("spans"), ("assign", "access", "hex", "model"))
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), window=35, digest=True).drop("spans")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_rules,
        op3_secret_scan,
        op4_jump_sharding,
        op5_benchmark_decontamination,
        op6_substring_dedup,
        op7_html_extraction,
        op8_warc,
        op9_language_id,
        op10_best_fit_packing,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_substring_dedup": phrase_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
}
