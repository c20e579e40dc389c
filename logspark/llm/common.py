"""What the operators share: the shared folder, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Words are runs of anything but these bytes (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        named = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own[app] = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable over undirected edges of longs, as (node, comp), for the nodes that edges name.

    Alternates large-star and small-star steps; each is one grouping by node, and the edge table shrinks towards stars.
    The neighbours of a node are never gathered: only their minimum is, so a node with any number of links is safe.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # stars: each node has one smaller neighbour, and that one has none
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and e.join(e.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").isEmpty():
            break
    comp = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comp.union(comp.select(F.col("comp").alias("node"), "comp").distinct())
