"""A corpus pipeline of five stages, each calling one operator of ``tessella.llm`` on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, mixing, near_duplicates, quality
from tessella.session import discard, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. Null and empty texts get the prior; repeated rows fare alike."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing is left goes with them. ``n_chars`` follows the text.
    Null and empty texts, and rows of null ids, stay as they are; rows that repeat an id and a text fare alike."""
    out = line_dedup.dedup_lines(docs, before="__before", removed="__removed").where("__removed = 0 or trim(text) <> ''")
    n = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one of the smallest id stays; repeated rows stay once.
    Null and empty texts are linked with nothing, rows of null ids stay."""
    gone = near_duplicates.near_duplicate_groups(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
    return left.withColumn("__row", mixing.row_hash(docs)).dropDuplicates(["doc_id", "__row"]).drop("__row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null and empty texts hold none; repeated rows fare alike."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot in the interleaved order of sources; a null source is one of them."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier, the winnowing or the signatures; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; what a stage has read goes when its result is written."""
    docs = before = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, done = materialize(stage(spark, docs, sf_dir)), docs
        if done is not before:
            discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
