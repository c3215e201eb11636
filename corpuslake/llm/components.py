"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): each node of edges (a, b) with the smallest node id of its component.

    Each round maps every node to the neighbour, or itself, of the least priority, and relabels the edges. In the
    first two rounds the priority is the id, which finishes stars about small ids at once; later it is random, and
    an expected constant share of the nodes goes, so rounds are logarithmic even on paths. A round's shuffle has
    a row for each live edge. Self-loops and repeated edges are allowed; nothing is collected.
    """
    live = staged(edges.where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if len(maps) < 2:
            least = both.groupBy("a").agg(F.min("b").alias("m"))
            to = F.least("m", "a")
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))), c)
            least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            to = F.when(F.col("m") < rank(F.col("a")), F.col("m.b")).otherwise(F.col("a"))
        step = staged(least.select(F.col("a").alias("id"), to.alias("to")), "hooks")
        maps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("y"))
        before, live = live, staged(live.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        drop_staged(before)
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    label = maps[0].select("id", F.col("to").alias("root"))
    for step in maps[1:]:
        label = label.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    if len(maps) <= 2:  # by ids alone, the root is the smallest
        return label.select("id", F.col("root").alias("comp"))
    label = staged(label, "roots")
    least = label.groupBy("root").agg(F.min("id").alias("comp"))
    return label.join(least, "root").select("id", "comp")
