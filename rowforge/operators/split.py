"""Stratified holdout split: equal texts stay on one side, marked rows on the training side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.fields import MARKS, is_marked
from rowforge.functions.text import combined_text, name, split_labels
from rowforge.operators.greedy import quota_items
from rowforge.session import settle


@dataclass(frozen=True)
class Split:
    train: DataFrame
    holdout: DataFrame
    stats: DataFrame


def holdout_split(
    df: DataFrame, row: str, text: list[str], label: str, fraction: float = 0.15, seed: int = 42, separator: str = ",",
    references: bool = True,
) -> Split:
    """Groups of equal text go to the holdout, in an order seeded by hash, while one of their labels needs rows.

    A label's target is `fraction` of the rows that may go there (half-even rounding), 1 at least.
    """
    body = combined_text(text, references)
    made = is_marked(MARKS[0]) if MARKS[0] in df.columns else F.lit(False)
    held_back = F.lit(False)
    for mark in MARKS:
        if mark in df.columns:
            held_back = held_back | is_marked(mark)
    rows = df.select(
        name(row).alias("row"), F.sha2(body, 256).alias("group"), F.md5(F.concat(F.lit(f"{seed}|"), body)).alias("ord"),
        F.array_distinct(split_labels(name(label), separator)).alias("labels"), made.alias("made"), held_back.alias("back"),
    )
    rows = settle(rows)
    groups = rows.groupBy("group").agg(F.max("ord").alias("ord"), F.bool_or("back").alias("back"))
    free = rows.join(groups.where("not back").select("group", F.col("ord").alias("_o")), "group")
    each = free.select("group", "ord", F.explode("labels").alias("label"))
    target = each.groupBy("label").agg(F.count("*").alias("n"))
    target = target.select("label", F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("n")).cast("long")).alias("quota"))
    weighted = each.groupBy("group", "label").agg(F.max("ord").alias("ord"), F.count("*").alias("weight"))
    taken = settle(quota_items(weighted.join(target, "label").withColumnRenamed("group", "item")))
    chosen = settle(rows.join(taken.withColumnRenamed("item", "group"), "group", "left_semi").select(F.col("row").alias("_row")))
    holdout = df.join(chosen, name(row) == chosen["_row"], "left_semi")
    train = df.join(chosen, name(row) == chosen["_row"], "left_anti")

    kept_back = rows.join(groups.where("back").select("group"), "group", "left_semi").where("not made")
    with_holdout = rows.join(chosen, F.col("row") == F.col("_row"), "left_semi").select(F.explode("labels").alias("label")).distinct()
    without = kept_back.select(F.explode("labels").alias("label")).distinct().join(with_holdout, "label", "left_anti")
    stats = (
        rows.agg(F.count("*").alias("rows"), F.count_if("made").alias("generated_excluded"))
        .crossJoin(chosen.agg(F.count("*").alias("holdout_rows")))
        .crossJoin(kept_back.agg(F.count("*").alias("real_kept_in_train")))
        .crossJoin(without.agg(F.array_sort(F.collect_list("label")).alias("labels_without_holdout")))
    )  # one row each
    stats = stats.withColumn("train_rows", F.col("rows") - F.col("holdout_rows"))
    stats = stats.withColumn("holdout_fraction_actual", F.coalesce(F.bround(F.try_divide("holdout_rows", "rows"), 3), F.lit(0.0)))
    return Split(train, holdout, stats.drop("rows"))
