"""Queries over keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigraph.operators import skew
from lumigraph.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of cluster_id with at least 5 % of the rows of assignment, and of cluster_file."""
    a = skew.heavy_keys(table(spark, sf_dir, "assignment"), "cluster_id", "face_id", "assigned_at")
    c = skew.heavy_keys(table(spark, sf_dir, "cluster_file"), "cluster_id", "media_path", "added_at")
    both = a.select(F.lit("assignment").alias("table_name"), "key").unionByName(c.select(F.lit("cluster_file").alias("table_name"), "key"))
    return both.select("table_name", F.col("key").cast("int").alias("cluster_id"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and files of every cluster: delivered rows, distinct faces, distinct paths, last change."""
    a = skew.per_key(table(spark, sf_dir, "assignment"), "cluster_id", "face_id", "assigned_at")
    c = skew.per_key(table(spark, sf_dir, "cluster_file"), "cluster_id", "media_path", "added_at")
    a = a.select("key", F.col("n_rows").alias("face_rows"), F.col("n_distinct").alias("n_faces"), F.col("most").alias("a_most"))
    c = c.select("key", F.col("n_rows").alias("file_rows"), F.col("n_distinct").alias("n_files"), F.col("most").alias("c_most"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return a.join(c, "key", "full").select(F.col("key").cast("int").alias("cluster_id"), zero("face_rows"), zero("n_faces"), zero("file_rows"), zero("n_files"), F.greatest("a_most", "c_most").cast("timestamp_ntz").alias("last_change"))


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}

ORACLE = {
    "p3_found": """
        select 'assignment' as table_name, cluster_id from assignment where cluster_id is not null group by cluster_id
        having count(*) >= 0.05 * (select count(cluster_id) from assignment)
        union all
        select 'cluster_file' as table_name, cluster_id from cluster_file where cluster_id is not null group by cluster_id
        having count(*) >= 0.05 * (select count(cluster_id) from cluster_file)""",
    "p3_clusters": """
        with a as (select cluster_id, count(*) as face_rows, count(distinct face_id) as n_faces, max(assigned_at) as m from assignment where cluster_id is not null group by cluster_id),
        c as (select cluster_id, count(*) as file_rows, count(distinct media_path) as n_files, max(added_at) as m from cluster_file where cluster_id is not null group by cluster_id)
        select coalesce(a.cluster_id, c.cluster_id) as cluster_id, coalesce(face_rows, 0) as face_rows, coalesce(n_faces, 0) as n_faces,
               coalesce(file_rows, 0) as file_rows, coalesce(n_files, 0) as n_files, greatest(a.m, c.m) as last_change
        from a full join c on a.cluster_id = c.cluster_id""",
}
