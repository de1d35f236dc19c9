"""Running counts and means over an order of all rows, without a window over all rows.

Rows are dealt out by ranges of the order; each range is summed by itself, the sums of the ranges before it are added. The table of the ranges' sums
has as many rows as there are partitions and groups, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """rows + a column per sum: the sum of its numbers over all rows up to and including this one, in `order`, per group `by`.

    `order` must tell rows apart, else those that it doesn't stand in any order. Null numbers count as 0. Null groups are one.
    """
    parts = {name: f"__{name}__" for name in sums}
    dealt = rows.withColumns({parts[name]: F.coalesce(c, F.lit(0)) for name, c in sums.items()})
    dealt = written(dealt, "rows")  # dealing by ranges reads its input twice, once for a sample
    dealt = written(dealt.repartitionByRange(*order).withColumn("__range__", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range__", *by).agg(*[F.sum(c).alias(c) for c in parts.values()])
    # of each group the ranges in order: as many rows as partitions at most
    earlier = W.partitionBy(*by).orderBy("__range__").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("__range__").alias("__at__"), *[F.col(c).alias(f"__of_{c}") for c in by], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}before") for c in parts.values()])
    within = W.partitionBy("__range__", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("__range__") == F.col("__at__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    out = dealt.withColumns({f"{c}here": F.sum(c).over(within) for c in parts.values()}).join(F.broadcast(before), same)
    return out.select(*rows.columns, *[(F.col(f"{c}here") + F.col(f"{c}before")).alias(name) for name, c in parts.items()])


def first_asked(asked: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """asked + reused: whether an equal question stands before this one. The first of each key is found by an aggregate: a key may be hot."""
    first = asked.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first__"))
    met = asked.join(first.withColumnsRenamed({k: f"__of_{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in key])
    return met.select(*asked.columns, (F.struct(*order) > F.col("__first__")).alias("reused"))


def model_statistics(requests: DataFrame, order: list[str]) -> DataFrame:
    """requests (model, seconds: null where it failed, reused) + of all requests up to each: n_requests, n_successes, mean_seconds of the successes,
    reuse_rate, and n_model, the successes of its model. A mean of none is 0. Decimal seconds are summed exactly."""
    ok = F.col("seconds").isNotNull().cast("long")
    sums = {"n_requests": F.lit(1).cast("long"), "n_successes": ok, "seconds_so_far": F.col("seconds"), "reused_so_far": F.col("reused").cast("long")}
    out = running(running(requests, order, sums), order, {"n_model": ok}, ("model",))
    mean = F.when(F.col("n_successes") > 0, F.col("seconds_so_far").cast("double") / F.col("n_successes")).otherwise(0.0)
    return out.withColumns({"mean_seconds": mean, "reuse_rate": F.col("reused_so_far") / F.col("n_requests")}).drop("seconds_so_far", "reused_so_far")


def observed(requests: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """requests, and what is told of them once an action has run over them: n, successes, seconds, reused. No pass of its own."""
    o = Observation(name)
    return requests.observe(o, F.count(F.lit(1)).alias("n"), F.count("seconds").alias("successes"), F.sum("seconds").alias("seconds"), F.count_if("reused").alias("reused")), o
