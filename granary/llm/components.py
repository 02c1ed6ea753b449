"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, stored


#: Nodes that a task holds at once.
MOST_NODES = 500_000


def _forest(batches):
    """A partition's links, MOST_NODES nodes at a time, as links to each local component's smallest node."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def told():
        nodes = [x for x in above if root(x) != x]
        return pa.record_batch({"a": pa.array([root(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > MOST_NODES:
            yield told()
            above.clear()
    yield told()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the links (a, b); a component is its smallest node.

    Partitions first reduce their links to a forest. Then, in turn, each node
    hangs its larger neighbours on the smallest node beside it and its smaller
    ones too, until nothing changes: the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder.
    If ``rounds`` run out before that, it raises.
    """
    ship(links.sparkSession)
    now = stored(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "a long, b long"), "links")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        toward = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = toward.groupBy("a").agg(F.min("b").alias("m"))
        last, now = now, stored(toward.join(lower, "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("l")).select("l.a", "l.b").where("a <> b").distinct(), "links")
        release(last)
        tally = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (tally["n"], tally["h"]) == before:
            break
        before = tally["n"], tally["h"]
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), F.col("m").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
