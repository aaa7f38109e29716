"""Graph store and table-metadata cache on shared storage.

Native form is Parquet: ``<path>/nodes``, ``<path>/edges`` and a one-row
``<path>/metadata``. The JSON document form of the original
(``{metadata, nodes[], edges[]}``) is readable too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions import constants as K


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, extra_metadata: dict | None = None) -> None:
    """K4: write nodes, edges and metadata (counts and time of writing)."""
    p = path.rstrip("/")
    nodes.write.mode("overwrite").parquet(f"{p}/nodes")
    edges.write.mode("overwrite").parquet(f"{p}/edges")
    spark = nodes.sparkSession
    meta = spark.read.parquet(f"{p}/nodes").agg(F.count(F.lit(1)).alias("node_count")).select(
        "node_count",
        spark.read.parquet(f"{p}/edges").agg(F.count(F.lit(1))).scalar().alias("edge_count"),
        F.current_timestamp().alias("updated_at"),
        *[F.lit(v).alias(k) for k, v in (extra_metadata or {}).items()])
    meta.write.mode("overwrite").parquet(f"{p}/metadata")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S14 (Parquet form): (nodes, edges)."""
    p = path.rstrip("/")
    return spark.read.parquet(f"{p}/nodes"), spark.read.parquet(f"{p}/edges")


def load_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S14 (document form): one JSON document with ``nodes`` and ``edges`` arrays."""
    doc = spark.read.option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    return nodes, edges


def clear_graph(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> None:
    """Replace the store with empty frames."""
    p = path.rstrip("/")
    spark.createDataFrame([], nodes_schema).write.mode("overwrite").parquet(f"{p}/nodes")
    spark.createDataFrame([], edges_schema).write.mode("overwrite").parquet(f"{p}/edges")


def save_table_cache(entries: DataFrame, path: str) -> None:
    """K5: one partition per cache key (database identity), dynamic overwrite so
    only the keys present are replaced; rows carry ``cache_version``."""
    (entries.withColumn("cache_version", F.lit(K.CACHE_VERSION))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path))


def load_table_cache(spark: SparkSession, path: str, cache_key: str | None = None) -> DataFrame:
    """Cache entries of the current version (partition-pruned by key)."""
    df = spark.read.parquet(path)
    if cache_key is not None:
        df = df.filter(F.col("cache_key") == cache_key)
    return df.filter(F.col("cache_version") == K.CACHE_VERSION)
