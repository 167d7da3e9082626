"""Merging of sources into one schema, twins, and suggestions for column mappings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.fields import MARKS, is_marked
from rowforge.functions.text import cell, combined_text, name, split_labels
from rowforge.operators.result import OpResult


@dataclass(frozen=True)
class Source:
    """A table with the source column of each target column, and the column that orders its rows, without repeats."""

    df: DataFrame
    mapping: dict[str, str | None]
    label: str
    order: str


def suggest_mapping(source: list[str], target: list[str]) -> dict[str, str | None]:
    """Target to source by equal name, else equal last token, else containment; each source once."""

    def last(column: str) -> str:
        return (re.findall("[a-z0-9]+", column.lower()) or [column.lower()])[-1]

    left, out = list(source), {}
    for column in target:
        tests = (lambda c: c == column, lambda c: last(c) == last(column), lambda c: last(column) in c.lower())
        hit = next((c for test in tests for c in left if test(c)), None)
        out[column] = hit
        if hit is not None:
            left.remove(hit)
    return out


def combine(sources: list[Source], target: list[str], text: list[str], references: bool = True) -> OpResult:
    """All sources in the target columns, with marks and a `source` label; of equal clean texts the first source's first row."""
    outside = [c for c in text if c not in target]
    if not text or outside:
        raise ValueError(f"The text columns must be some of the target's; not among them: {outside}.")
    marks = [m for m in MARKS if m not in target and any(m in s.df.columns for s in sources)]
    shaped = []
    for i, source in enumerate(sources):
        columns = [cell(source.mapping[c]).alias(c) if source.mapping.get(c) in source.df.columns else F.lit("").alias(c) for c in target]
        own = [F.when(is_marked(m), cell(m)).otherwise("").alias(m) if m in source.df.columns else F.lit("").alias(m) for m in marks]
        shaped.append(source.df.select(*columns, *own, F.lit(source.label).alias("source"), F.lit(i).alias("_priority"), name(source.order).cast("long").alias("_order")))
    both = reduce(DataFrame.unionByName, shaped)
    # Only the pass that looks for each text's first row reads the clean texts; rows are then known by their place.
    keyed = both.select(F.sha2(combined_text(text, references), 256).alias("_key"), F.struct("_priority", "_order").alias("_place"))
    first = keyed.groupBy("_key").agg(F.min("_place").alias("_first")).select("_first.*")
    kept = both.join(first, ["_priority", "_order"], "left_semi")
    rows_in = both.groupBy("source").agg(F.count("*").alias("rows_in"))
    rows_kept = kept.groupBy("source").agg(F.count("*").alias("rows_kept"))
    stats = rows_in.join(rows_kept, "source", "left").fillna(0, ["rows_kept"])
    return OpResult(kept.drop("_priority", "_order"), stats)


def twin_key(text: list[str], label: str | None, separator: str = ",", references: bool = True):
    """Rows with equal clean text and equal label sets share this digest."""
    labels = F.array_sort(F.array_distinct(split_labels(name(label), separator))) if label else F.array().cast("array<string>")
    return F.sha2(F.concat_ws("\x1f", combined_text(text, references), F.array_join(labels, "\x1f")), 256)
