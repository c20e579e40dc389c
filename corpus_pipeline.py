"""The corpus pipeline: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import bpe, mixing, neardup, pii, quality
from logspark.llm.common import cut, table


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely bad or toxic than not."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, model).where("__keep"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays, that with the smallest id. Null ids stay.

    Rows that repeat an id are versions of one document: the one whose text comes first in byte order stays (of equal ones, any).
    """
    found = neardup.near_duplicates(docs, k=5, percent=80)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, docs["doc_id"] == F.col("__kept"), "left_semi")
    again = named.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__again"))
    once = named.join(again, F.col("doc_id") == F.col("__again"), "left_anti")
    # a group holds the rows of one id: of them, the least stays
    all_columns = F.struct(F.col("text"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    first = named.join(again, F.col("doc_id") == F.col("__again")).groupBy("__again").agg(F.min(all_columns).alias("__row")).select("__row.*")
    return _columns(once.unionByName(first).unionByName(docs.where("doc_id is null")), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the new text."""
    out = pii.pseudonymise(docs, pii.KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__pii_n") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _columns(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each taken document."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL can state neither the classifier nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
