"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import discard, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one end above it or is such an end, not both: then each component hangs on its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("below")).union(edges.select("b", F.lit(0), F.lit(1)))
    other = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("below").alias("below")).filter("ups + below > 1")
    return other.agg(F.count(F.lit(1))).first()[0] == 0  # one number


def connected_components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component; roots are left out.
    ``discard`` deletes its table.

    Both steps are grouped minima, combined before the shuffle, and a join back to the edges that adaptive execution
    splits at hot nodes. Each round is written to the shared folder, so lineage stays short. Rounds end as soon as all
    components are stars; a table of stars, as hubs with what links to them are, needs none.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        if _stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = materialize(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        discard(now)
        now = then
    else:
        raise RuntimeError(f"no components after {most} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.tideway_path = now.tideway_path
    return out
