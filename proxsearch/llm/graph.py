"""Connected components over links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, join_unique, shared_dir

#: Up to so many links (16 MB) are joined on the driver; more take rounds over the cluster, with the same result.
DRIVER_LINKS = 1 << 20


def union(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Joins a[i] and b[i] in ``parent``, whose roots are the smallest of their sets."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(links: DataFrame, a: str = "a", b: str = "b", driver_links: int = DRIVER_LINKS) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` of longs, for each node in one.

    Beyond ``driver_links``, rounds of large-star and small-star, each written to the shared folder; a round moves every
    link once, and their number grows with the logarithm of the longest path. A node linked to a
    large share of all others is joined by broadcast (join_unique), so no task gets all its links.
    """
    spark = links.sparkSession
    few = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).limit(driver_links + 1).toArrow()
    if few.num_rows <= driver_links:
        nodes, at = np.unique(np.concatenate((few["a"].to_numpy(), few["b"].to_numpy())), return_inverse=True)
        root = union(at[: few.num_rows], at[few.num_rows :], np.arange(len(nodes)))
        return spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(nodes[root], pa.int64())}))
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    nodes_of = links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct()
    path, read = shared_dir(spark), spark.read.schema(nodes_of.schema).parquet
    nodes_of.write.parquet(path)
    while True:
        now = read(path)
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")).withColumn("m", F.least("m", "u"))
        large = join_unique(both, least, ["u"], "w", total, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid_path = shared_dir(spark)
        large.distinct().write.parquet(mid_path)
        mid = read(mid_path)
        # small-star: each node's larger-to-smaller links move to its smallest neighbour
        least = mid.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
        moved = join_unique(mid, least, ["u"], "w", total, "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = moved.where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new_path = shared_dir(spark)
        new.write.parquet(new_path)
        new = read(new_path)
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() or new.count() != total // 2
        for p in (path, mid_path):
            delete(spark, p)
        path = new_path
        if not changed:
            break
    found = read(path)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
