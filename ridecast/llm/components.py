"""Connected components of a written table of links, by alternating stars.

Each round gives every row's larger end the smallest neighbour of its component so far (the
large and the small star of Kiveris et al., 2014); the number of rounds grows with the
logarithm of the longest chain. Every round is a written table, so no plan grows and a lost
executor costs at most one round. What decides about a round is counted while its tables are
written, so a round needs no job for that: the driver keeps threads, broadcasts and a record of every job.
Nothing but a few counts reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ridecast.llm.scratch import written

#: A key with more than one of so many rows is hot; there are fewer than so many hot keys.
HOT = 1000
#: So many keys are broadcast together, whatever rows they have (some hundred kilobytes).
FEW_KEYS = 1 << 14


def written_and_counted(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, tuple]:
    """A written table and aggregates of its rows, taken while they are written."""
    watch = Observation()
    numbered = [c.alias(f"_{i}") for i, c in enumerate(counts)]
    table = written(df.observe(watch, *numbered), name)
    found = watch.get
    if len(found) < len(counts):  # Spark may find out that there are no rows, and leaves the counts away then
        return table, tuple(table.agg(*numbered).first())
    return table, tuple(found[f"_{i}"] for i in range(len(counts)))


def _sizes(count: str) -> list[Column]:
    return [F.count(F.lit(1)), F.sum(count), F.max(count)]


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, other: str, count: str, sizes: tuple | None = None) -> DataFrame:
    """Inner join of `rows` with a written table of unique keys, `other`, and their numbers of rows, `count`.

    The fewer than `HOT` keys that have more than that share of the rows each are broadcast, so
    the rows of a hot key stay where they are; the others meet their key by a shuffle. `FEW_KEYS` or fewer keys are
    broadcast all at once. `sizes` are the number of keys, the sum of `count` and its maximum, if they are known.
    """
    keys, total, most = sizes or keyed.agg(*_sizes(count)).first()
    on = F.col(key) == F.col(other)
    if keys <= FEW_KEYS:
        return rows.join(F.broadcast(keyed), on)
    if most * HOT <= total:
        return rows.join(keyed, on)
    hot = F.col(count) * HOT > total
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(few.select(other), on, "left_anti").join(keyed.where(~hot), on)
    return rows.join(few, on).unionByName(rest)


def _large_star(links: DataFrame, name: str) -> DataFrame | None:
    """Join every larger neighbour of a node to the node's smallest neighbour (or itself); None if all are already."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    larger = F.count(F.when(F.col("b") > F.col("a"), 1)).alias("_rows")
    least = both.groupBy(F.col("a").alias("_node")).agg(F.least(F.min("b"), F.first("a")).alias("_least"), larger)
    moving = F.count_if(F.col("_least") < F.col("_node"))
    least, (moved, *sizes) = written_and_counted(least.where("_rows > 0"), f"{name}-least", moving, *_sizes("_rows"))
    if not moved:
        return None
    stars = join_counted(both.where("b > a"), least, "a", "_node", "_rows", sizes)
    return written(stars.select(F.col("b").alias("a"), F.col("_least").alias("b")), f"{name}-large")


def _small_star(links: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """Join a node and its smaller neighbours to the smallest of them; and whether each had only one before.

    `links` lead from the larger to the smaller end.
    """
    several = F.max("b") > F.min("b")
    least = links.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("_least"), F.count(F.lit(1)).alias("_rows"), several.alias("_several"))
    least, (open_nodes, *sizes) = written_and_counted(least, f"{name}-smallest", F.count_if("_several"), *_sizes("_rows"))
    single = least.select(F.col("_node").alias("a"), F.col("_least").alias("b"))
    if not open_nodes:
        return single, True
    joined = join_counted(links, least.drop("_several"), "a", "_node", "_rows", sizes)
    moved = joined.where("b > _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return written(moved.unionByName(single).distinct(), f"{name}-star"), False


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node it can reach."""
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, single = written(down.distinct(), f"{name}-links"), False
    while True:
        large = _large_star(now, name)
        # All stars: no link leads to a node that has a smaller neighbour itself, and each node has one link down.
        if large is None and single:
            break
        now, single = _small_star(now if large is None else large, name)
        if large is None and single:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
