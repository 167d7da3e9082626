"""Looking at tables: pages with search, review of samples, audit of predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import cell, name
from rowforge.operators.result import OpResult


@dataclass(frozen=True)
class PageIndex:
    """Where the rows that match a search lie: for each range of the order column (first, last, rows before it), in order.

    Rows without an order value come first, in a range (None, None, 0).
    """

    order: str
    total: int
    matched: int
    ranges: list[tuple[object, object, int]]


#: Rows before a page from which on page() makes an index, and the most ranges of one.
DEEP, RANGES = 10_000, 4_096


def _visible(df: DataFrame, columns: list[str] | None) -> list[str]:
    visible = list(columns or df.columns)
    unknown = [c for c in visible if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown columns: {unknown}.")
    return visible


def _hit(query: str, visible: list[str]) -> Column:
    hit = F.lit(True)
    if query:
        hit = F.lit(False)
        for c in visible:
            hit = hit | F.lower(cell(c)).contains(query.lower())
    return hit


def page_index(df: DataFrame, order: str, query: str = "", columns: list[str] | None = None, ranges: int | None = None) -> PageIndex:
    """An index of the rows that match: one pass that shuffles their order values alone, for any number of pages.

    The driver gets the boundaries of `ranges` ranges at most; without it of RANGES, or fewer of DEEP rows each. Equal
    order values share a range.
    """
    hit = _hit(query, _visible(df, columns))
    total, matched = df.agg(F.count("*"), F.count_if(hit)).first()
    ranges = ranges or min(RANGES, matched // DEEP + 1)
    held = df.where(hit).select(name(order).alias("o")).repartitionByRange(ranges, "o")
    dealt = held.groupBy(F.spark_partition_id().alias("p"), F.col("o").isNull().alias("none")).agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n"))
    found = sorted(dealt.collect(), key=lambda r: (not r["none"], r["p"]))
    out, before = [], 0
    for r in found:
        out.append((r["first"], r["last"], before))
        before += r["n"]
    return PageIndex(order, total, before, out)


def page(
    df: DataFrame, order: str, query: str = "", columns: list[str] | None = None, offset: int = 0, limit: int = 50, index: PageIndex | None = None
) -> OpResult:
    """A page of the rows that hold `query` in a visible column, whatever its case; stats: total, matched.

    A page far from the beginning is read by an index, which is made where none is given: of the rows before it only
    those of its own range are sorted, and the range's bounds reach the scan as filters.
    """
    visible = _visible(df, columns)
    hit = _hit(query, visible)
    if index is None and offset >= DEEP:
        index = page_index(df, order, query, columns)
    if index is None:
        stats = df.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"))
        rows = df.where(hit).orderBy(name(order))
    else:
        stats = df.sparkSession.createDataFrame([(index.total, index.matched)], "total long, matched long")
        after = [before for *_, before in index.ranges[1:]] + [index.matched]
        asked = [r for r, end in zip(index.ranges, after, strict=False) if r[2] < offset + limit and end > offset]
        inside, skipped = F.lit(False), asked[0][2] if asked else 0
        filled = [r for r in asked if r[0] is not None]
        if len(filled) < len(asked):
            inside = name(order).isNull()
        if filled:
            inside = inside | name(order).between(F.lit(filled[0][0]), F.lit(filled[-1][1]))
        rows, offset = df.where(hit & inside).orderBy(name(order)), offset - skipped
    return OpResult(rows.offset(offset).limit(limit).select(*[name(c) for c in visible]), stats)


def browse(samples: DataFrame, concept: str | None = None, status: str | None = None, min_sim: float | None = None) -> DataFrame:
    """Samples of a concept and status with at least this similarity, before paging."""
    if concept:
        samples = samples.where(F.col("concept") == concept)
    if status:
        samples = samples.where(F.col("status") == status)
    if min_sim is not None:
        samples = samples.where(F.coalesce("sim_max", F.lit(0.0)) >= min_sim)
    return samples


def update_status(samples: DataFrame, updates: DataFrame) -> DataFrame:
    """Samples with the statuses of `updates` (id, new_status); unknown ids change nothing."""
    out = samples.join(updates.select(F.col("id").alias("_id"), "new_status"), F.col("id") == F.col("_id"), "left")
    return out.withColumn("status", F.coalesce("new_status", "status")).select(*[name(c) for c in samples.columns])


def audit_predictions(gold: DataFrame, predictions: DataFrame, confidence: float = 0.8, top_k: int = 3) -> DataFrame:
    """Rows whose first prediction is confident while none of the first `top_k` is a gold label.

    `gold` has row and labels; `predictions` row and ranked, an array of (uri, confidence). Rows without
    predictions are left out; rows without gold labels count as missed.
    """
    both = gold.join(predictions, "row").where(F.size("ranked") > 0)
    first: Column = F.col("ranked")[0]
    top = F.transform(F.slice("ranked", 1, top_k), lambda p: p["uri"])
    missed = ~F.arrays_overlap(top, F.coalesce("labels", F.array().cast("array<string>")))
    return both.where((first["confidence"] >= confidence) & missed).select(
        "row", F.array_join(F.array_sort("labels"), ",").alias("gold"), first["uri"].alias("top_prediction"),
        F.round(first["confidence"], 4).alias("top_confidence"),
        F.array_join(F.transform("ranked", lambda p: p["uri"]), ",").alias("model_top"),
    )
