"""Connected components of an undirected graph whose edges are rows (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_dir


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component): the smallest node that links reach, for every node with an edge.

    Alternates large-star and small-star steps until the edges are the stars of the components, which
    takes about log2 of the longest path. Each step is written to the shared scratch folder, so lineage
    stays short and a lost executor costs a reread. Minima are merged before each shuffle and a node with
    very many neighbours is split by the skew handling of joins. Null ends and loops are left out.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    path, mark = "", None
    while True:
        both = _both(now)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        last, path = path, scratch_dir(spark, label)
        small.write.parquet(path)
        now = spark.read.schema(small.schema).parquet(path)
        if last:
            drop_path(spark, last)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
