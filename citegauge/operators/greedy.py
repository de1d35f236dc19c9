"""Order-dependent choices, as the loop over rows makes them, in rounds over tables.

The loop goes through rows in order and keeps each that nothing kept before it excludes. A row may be decided as soon as no
undecided row before it excludes it, so each round decides all such rows at once; the outcome is that of the loop. Rounds
grow with the longest chain of rows that hang on each other, not with the rows; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def seeds(nodes: DataFrame, edges: DataFrame, group: str, at: str) -> DataFrame:
    """nodes (group, at) + seed: in order of `at`, a row that no earlier seed of its group is linked with is one, and takes what later rows are linked
    with it alone. edges: (group, a, b) with a < b, each once; a row is taken by the first seed that it is linked with."""
    edges = written(edges, "edges")
    left, taken = edges, None
    while not left.isEmpty():
        first = left.select(group, "a").distinct().join(left.select(group, F.col("b").alias("a")).distinct(), [group, "a"], "left_anti")
        gone = written(left.join(first, [group, "a"]).select(group, F.col("b").alias(at)).distinct(), "taken")
        taken = gone if taken is None else taken.union(gone)
        over = gone.union(first.withColumnRenamed("a", at))
        for end in "ab":
            left = left.join(over.withColumnRenamed(at, end), [group, end], "left_anti")
        left = written(left.select(group, "a", "b"), "edges")
    if taken is None:
        return nodes.withColumn("seed", F.col(at))
    taken = written(taken.distinct(), "taken")
    mine = edges.join(taken.withColumnRenamed(at, "b"), [group, "b"], "left_semi").join(taken.withColumnRenamed(at, "a"), [group, "a"], "left_anti")
    mine = mine.groupBy(group, F.col("b").alias(at)).agg(F.min("a").alias("seed"))
    return nodes.join(mine, [group, at], "left").withColumn("seed", F.coalesce("seed", at))


def keep_apart(rows: DataFrame, group: str, order: str, keys: list[str]) -> DataFrame:
    """The rows that the loop keeps: in order, a row goes if one of its keys stands in a row of its group that was kept.

    A null key excludes nothing. `order` must tell the rows of a group apart. Smallest rows of keys are found by aggregates, so
    a key of very many rows is cut down before the shuffle.
    """
    left, out = written(rows.select(group, order, *keys), "undecided"), None
    while not left.isEmpty():
        kept = left
        for k in keys:
            least = left.where(F.col(k).isNotNull()).groupBy(group, k).agg(F.min(order).alias(f"__{k}__"))
            kept = kept.join(least, [group, k], "left")
        first = [F.col(k).isNull() | (F.col(order) == F.col(f"__{k}__")) for k in keys]
        for c in first:
            kept = kept.where(c)
        kept = written(kept.select(group, order, *keys), "kept")
        out = kept if out is None else out.union(kept)
        left = left.join(kept.select(group, order), [group, order], "left_anti")
        for k in keys:
            left = left.join(kept.where(F.col(k).isNotNull()).select(group, k), [group, k], "left_anti")
        left = written(left.select(group, order, *keys), "undecided")
    return rows.join(out.select(group, order), [group, order], "left_semi") if out is not None else rows
