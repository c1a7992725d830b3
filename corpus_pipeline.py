"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes what its predecessor kept, written as Parquet and reread.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bitfilter import marked_by
from weftgraph.llm.decontaminate import benchmark_hits
from weftgraph.llm.ngram_join import ngram_jaccard_join
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.quality_rules import quality_rules
from weftgraph.llm.queries import table, vocabulary
from weftgraph.llm.secret_scan import scan_secrets
from weftgraph.llm.storage import Scratch

#: What stands in a text where a secret was.
MASK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules themselves nor come from a host that mostly fails."""
    return quality_rules(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 the one with the least id.

    Rows without id belong to no group and stay.  Of rows that repeat the kept
    id one of each text stays.
    """
    scratch = Scratch(spark, "pipeline-near")
    classes = ngram_jaccard_join(docs, size=5, percent=80).where("doc_id is not null")
    marks = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n"))
    marks = scratch.keep(marks.where("gone or n > 1").select("doc_id", "gone"), "marks")
    # Only documents that may be marked are shuffled.
    looked = marked_by(docs, "doc_id", marks, "_marked")
    unmarked = looked.where("not _marked").select(*docs.columns)
    single = looked.where("_marked").join(marks.select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    kept_again = marks.where("not gone").select("doc_id")
    if kept_again.isEmpty():
        return unmarked.unionByName(single)
    repeated = looked.where("_marked").join(kept_again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return unmarked.unionByName(single).unionByName(repeated)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; a verdict belongs to a text, as ids may be null or repeated."""
    scratch = Scratch(spark, "pipeline-leaks")
    digest = F.sha2(F.col("text").cast("string"), 256)
    hits = benchmark_hits(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), window=10)
    gone = scratch.keep(hits.where("contaminated").select(F.col("doc_id").alias("_digest")).distinct(), "gone")
    looked = marked_by(docs.withColumn("_digest", digest), "_digest", gone, "_marked")
    clean = looked.where("_marked").join(gone.hint("merge"), "_digest", "left_anti").select(*docs.columns)
    return looked.where("not _marked").select(*docs.columns).unionByName(clean)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret replaced by ``MASK``; n_chars follows the text."""
    found = scan_secrets(docs, keep_cols=docs.columns)

    def cut(text, spans):
        # Overlapping findings become one mask: `at` is the end of what is masked so far.
        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK)).alias("out"), s["end"].alias("at"),
        )).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
        rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(spans, start, step, rest)

    masked = F.when(F.size("spans") > 0, cut(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    columns = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.withColumn("masked", masked).select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return pack_documents(docs, vocabulary(), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs


#: Token ids, trained scores and component search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
