"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspar.work import compact, remove

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes with an edge; label is the component's smallest node.

    ``edges(src, dst)`` is undirected; self-loops and repeats do no harm, rows with a
    null end are left out. Each round shuffles the edges a constant number of times and
    replaces them by ones that reach further towards the smallest node, so the number of
    rounds grows with the logarithm of the longest chain. Rounds are written to the
    shared folder; nothing but two numbers a round comes to the driver.
    """
    spark = edges.sparkSession
    clean = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    state = compact(clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        new = compact(_small_star(_large_star(state).distinct()).distinct(), "edges")
        mark = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first())
        remove(spark, state.inputFiles()[0].rsplit("/", 1)[0]) if state.inputFiles() else None
        state = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return state.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(
        state.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    )
