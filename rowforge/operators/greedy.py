"""Order-dependent and iterative operators without driver loops over rows.

Greedy quota: items come in order; an item is taken while any of its labels is below its quota, and adds
its weight to all its labels. An item is passed over only when all its labels are full, and a full label
stays full; so while a label is below its quota none of its earlier items was passed over, and the running
weight of all its earlier items equals that of the taken ones. One window sum therefore decides exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.session import settle


def quota_items(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Items (distinct `item`) that a greedy quota takes.

    `edges` has item, label, ord (the item's place), quota (of the label) and weight (1 or more). `most`
    bounds all quotas; then only a label's first `most` edges are looked at, which bounds a hot label's
    window. Without it the edges are dealt into ranges of (label, ord), so that a hot label has many: the sums of the
    ranges before it say where a range begins, and ranges behind the one where the quota is met are left out.
    """
    edges = edges.select("item", "label", "ord", "quota", "weight")
    if most is not None:
        by_label = Window.partitionBy("label").orderBy("ord", "item")
        edges = edges.withColumn("n", F.row_number().over(by_label)).where(F.col("n") <= F.lit(most))
        before = F.sum("weight").over(by_label.rowsBetween(Window.unboundedPreceding, -1))
        return edges.withColumn("before", F.coalesce(before, F.lit(0))).where("before < quota").select("item").distinct()
    edges = settle(edges.repartitionByRange("label", "ord", "item").withColumn("range", F.spark_partition_id()))
    sums = edges.groupBy("label", "range").agg(F.sum("weight").alias("weight"))
    ahead = F.sum("weight").over(Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("label", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))  # no more than there are ranges
    edges = edges.join(sums, ["label", "range"]).where("ahead < quota")
    within = F.sum("weight").over(Window.partitionBy("label", "range").orderBy("ord", "item").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("before", F.col("ahead") + F.coalesce(within, F.lit(0)))
    return edges.where("before < quota").select("item").distinct()


def learnable(edges: DataFrame, rows: int, least: int) -> tuple[DataFrame, int]:
    """Labels with `least` rows with them and as many without, and the number of rows that keep one.

    `edges` has item and label, distinct. Rows left without a label go, which may make others too common;
    repeated until nothing changes. A surviving label's own count never changes. Each round but the last takes a label
    or a row away, so the rounds end.
    """
    edges = settle(edges.select("item", "label"))
    while True:
        counts = edges.groupBy("label").count()
        keep = counts.where((F.col("count") >= least) & (F.lit(rows) - F.col("count") >= least)).select("label")
        left = settle(edges.join(keep, "label", "left_semi"))
        after = left.select("item").distinct().count()
        if after == rows and left.count() == edges.count():
            return keep, rows
        edges, rows = left, after


#: Undecided links that one task finishes, about 16 bytes each, and rounds in parallel before ranges of links are finished.
LOCAL_LINKS, ROUNDS = 1 << 20, 6


def later_dropped(a: np.ndarray, b: np.ndarray) -> set[int]:
    """The nodes that a pass in ascending order drops, of the links a < b among undecided nodes."""
    dropped: set[int] = set()
    for later, earlier in sorted(zip(b.tolist(), a.tolist(), strict=True)):
        if earlier not in dropped:
            dropped.add(later)
    return dropped


def _finished(links: DataFrame) -> DataFrame:
    """(id, kept) of all nodes of a bounded number of links, by one pass in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dropped = later_dropped(group["a"].to_numpy(), group["b"].to_numpy())
        nodes = np.unique(group[["a", "b"]].to_numpy())
        return pd.DataFrame({"id": nodes, "kept": [n not in dropped for n in nodes.tolist()]})

    return links.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "id long, kept boolean")


def first_independent(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_LINKS, rounds: int = ROUNDS) -> DataFrame:
    """Nodes that a pass in ascending order keeps, dropping each node with a link to an earlier kept one.

    `nodes` has id; `edges` has a < b. First in rounds: a node without an undecided earlier neighbour is kept, and what
    it is linked to is dropped; that decides most of a graph at once. A chain of links in ascending order would take as
    many rounds as it is long. So as soon as no more than `local` links are left between undecided nodes, or after
    `rounds` rounds, a pass in one task finishes them: all of them, or those of the smallest nodes that have about that
    many links among themselves, to which no other undecided node can matter. A chain of n links thus takes about
    n / local passes. The result is the same for any `local` and `rounds`.
    """
    links, dropped, done = settle(edges.select("a", "b").distinct()), None, 0
    while left := links.count():
        done += 1
        if left > local and done <= rounds:
            first = links.select(F.col("a").alias("id")).distinct().join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
            gone = links.join(first.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        else:
            part = links
            if left > local:
                bound = links.agg(F.percentile_approx("b", local / left, 1_000_000)).first()[0]
                part = links.where(F.col("b") < F.lit(bound))
                if part.isEmpty():  # the smallest nodes have more links than a pass takes: they are decided by a round
                    rounds = done + 1
                    continue
            found = settle(_finished(part))
            beyond = links.join(found.where("kept").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
            gone = found.where("not kept").select("id").unionByName(beyond).distinct()
        gone = settle(gone)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        for end in "ab":
            links = links.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        links = settle(links)
    return nodes.select("id") if dropped is None else nodes.select("id").join(dropped, "id", "left_anti")
