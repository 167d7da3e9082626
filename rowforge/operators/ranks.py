"""Exact percentiles of many groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.text import name
from rowforge.session import settle


def percentiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(*by, and a column for each share) from (*by, x, n): a value's percentiles, n rows having it.

    A percentile lies at a rank between two rows, between whose values it is interpolated. The values are dealt into
    ranges of (by, x), of which a group of very many has many. The numbers of rows in each range say in which ranges the
    wanted ranks lie; only these are looked at again, each by a window of its own. Values that are null count for nothing;
    a group without any other has no row.
    """
    keys = [name(c) for c in by]
    held = counts.where("x is not null").select(*keys, F.col("x").cast("double").alias("x"), F.col("n").cast("long").alias("n"))
    dealt = settle(held.repartitionByRange(*keys, "x").withColumn("range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    sums = dealt.groupBy(*by, "range").agg(F.sum("n").alias("rows"))  # no more for a group than there are ranges
    sums = sums.withColumns({"end": F.sum("rows").over(group.orderBy("range")), "total": F.sum("rows").over(group)})
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(p) * (F.col("total") - 1)).alias("rank")) for i, p in enumerate(shares.values())]))
    asked = sums.withColumn("s", place).select(*keys, "range", (F.col("end") - F.col("rows")).alias("ahead"), "end", "s.*")
    asked = asked.withColumn("at", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))))
    asked = settle(asked.where("at >= ahead and at < end").select(*keys, "range", "ahead", "share", "rank", "at"))
    ranges = asked.select(*keys, "range", "ahead").distinct()
    within = Window.partitionBy(*keys, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    numbered = dealt.join(ranges, [*by, "range"]).withColumn("last", F.col("ahead") + F.sum("n").over(within))
    numbered = numbered.withColumn("first", F.col("last") - F.col("n")).drop("ahead", "n")
    met = numbered.join(asked.drop("ahead"), [*by, "range"]).where("at >= first and at < last")
    ends = met.groupBy(*by, "share", "rank").agg(F.min_by("x", "at").alias("low"), F.max_by("x", "at").alias("high"))
    between = (F.ceil("rank") - F.col("rank")) * F.col("low") + (F.col("rank") - F.floor("rank")) * F.col("high")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("share") == i, value)).alias(c) for i, c in enumerate(shares)])
