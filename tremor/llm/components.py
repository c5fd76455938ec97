"""Connected components of an edge table, by hooking to the least neighbour and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the least node of the component. Nodes are those of the edges; loops and repeats do no harm.

    Each round hooks every component to its least neighbour, which at least halves their number, and follows the hooks to
    their ends by doubling. All tables are written out between steps, so no lineage grows and joins on a crowded key can
    be split by Spark.
    """
    left = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        parent = stage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")), "hooks")
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            jumped = stage(parent.join(up, "comp").select("node", F.col("up").alias("comp"), (F.col("up") != F.col("comp")).alias("moved")), "jumps")
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "comp")
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            labels = stage(labels.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
        to = parent.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        half = left.join(to, "a").select("ca", "b")
        left = stage(half.join(to.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
