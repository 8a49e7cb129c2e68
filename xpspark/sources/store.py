"""Stored node relations: written once, read by many queries.

``save`` partitions by kind and local name, so that a node test prunes folders, and sorts by document and position, so
that Parquet statistics skip row groups. ``save_bucketed`` deals a table by document, so that structural joins, which all
are on ``doc_id``, need no shuffle; the session must let a join use the bucketing of a part of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets joins on (doc_id, parent) use data that is dealt by doc_id alone.
CO_LOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


def save(nodes: DataFrame, path: str) -> None:
    rows = nodes.withColumns({"part_kind": F.col("kind"), "part_local": F.coalesce("local", F.lit(""))})
    rows.sortWithinPartitions("part_kind", "part_local", "doc_id", "pre").write.mode("overwrite").partitionBy("part_kind", "part_local").parquet(path)


def load(spark: SparkSession, path: str, kind: int | None = None, local: str | None = None) -> DataFrame:
    """The nodes, or those of a kind and name, which are then the only ones that are read."""
    rows = spark.read.option("basePath", path).parquet(path)
    if kind is not None:
        rows = rows.where(F.col("part_kind") == kind)
    if local is not None:
        rows = rows.where(F.col("part_local") == local)
    return rows.drop("part_kind", "part_local")


def save_bucketed(nodes: DataFrame, table: str, buckets: int) -> None:
    nodes.sparkSession.conf.set(CO_LOCATED, "false")
    nodes.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "pre").mode("overwrite").saveAsTable(table)
