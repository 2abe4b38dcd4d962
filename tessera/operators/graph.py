"""Equivalence classes of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut

#: Parts that the edges of one lesser end are dealt over: a root may have a third of all nodes.
SALTS = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of edges (u, v) of any ordered type; root is the least node of the class.

    Alternating stars over edges that point from the greater end u to the lesser v.  Large star: each edge's lesser end is replaced
    by that end's own least neighbour.  Small star: all lesser neighbours of a node, and the node, point to the least of
    them.  Each round is three aggregations and three joins and is checkpointed; the number of rounds grows with the logarithm of the
    longest path.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(True).alias("moved")))
    while True:
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        # only nodes between others have to be looked up; the many edges of one lesser end are dealt over SALTS copies of its row
        between = least.join(e.select("v").distinct(), "v").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = e.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = dealt.join(between, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        other = F.col("v") != F.col("m")
        e = cut(large.join(small, "u").select(F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (other | F.col("moved")).alias("moved")).unionByName(small.select("u", F.col("m").alias("v"), F.lit(False).alias("moved"))))
        if not e.agg(F.max("moved").alias("moved")).first()["moved"]:
            star = e.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
            return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def canonical_groups(edges: DataFrame, max_group: int = 25) -> DataFrame:
    """(src, dst) for each form that isn't its class's canonical one: the form most used as a target, then the shortest, then the least.

    edges: src, dst, one row per equivalence; classes of more than ``max_group`` forms are left out.
    """
    member = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    used = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used"))
    ranked = member.join(used, "node", "left").select("root", "node", F.struct((-F.coalesce("used", F.lit(0))).alias("a"), F.char_length("node").alias("b"), F.col("node").alias("c")).alias("k"))
    best = ranked.groupBy("root").agg(F.min("k").alias("k"), F.count("*").alias("n")).where(F.col("n") <= max_group).select("root", F.col("k.c").alias("dst"))
    return ranked.join(best, "root").where("node <> dst").select(F.col("node").alias("src"), "dst")
