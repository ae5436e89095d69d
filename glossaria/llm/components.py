"""Connected components by alternating large-star and small-star steps, each a combined aggregation and an equi-join.

Nothing is collected but two numbers per step; the edges of each step are written to the shared folder, so that a lost
executor costs one step. A node with very many neighbours is met by aggregation (combined before the shuffle) and by a
join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every node with an edge to another: comp is the smallest id it can reach. Null ends are left out."""
    now = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        now = stash(small, "edges")
        if (new := _mark(now)) == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
