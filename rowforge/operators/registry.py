"""Operations by name: one call for previews, saved datasets and their history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import cell, combined_text
from rowforge.operators import columns, keys, labels, rules, vectors
from rowforge.operators.result import OpResult


@dataclass(frozen=True)
class Context:
    """What an operation knows of a table: its order column, its text and label columns, an encoder of texts."""

    row: str
    text: list[str] = field(default_factory=list)
    label: str | None = None
    separator: str = ","
    encode: Callable | None = None


def _counted(before: DataFrame, after: DataFrame) -> OpResult:
    """Statistics of an operation that only drops rows or columns."""
    counts = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
    return OpResult(after, counts.withColumn("removed", F.col("before") - F.col("after")).withColumn("changed", F.lit(0)))


def _semantic(df: DataFrame, params: dict, ctx: Context) -> OpResult:
    if ctx.encode is None:
        raise ValueError("Semantic deduplication needs an encoder.")
    coded = vectors.encode_texts(df, combined_text(ctx.text), ctx.encode, "_vector")
    return _counted(df, vectors.dedupe_semantic(coded, ctx.row, "_vector", float(params.get("threshold", 0.95))).drop("_vector"))


_FILTERS = {
    "dedupe_exact": lambda df, p, c: _counted(df, labels.dedupe_exact(df, c.row, c.text)),
    "dedupe_semantic": _semantic,
    "length": lambda df, p, c: _counted(df, labels.length_filter(df, c.text, int(p.get("min", 0)), int(p.get("max", 10**9)))),
    "drop_no_label": lambda df, p, c: _counted(df, labels.drop_no_label(df, c.label, c.separator)),
    "label_filter": lambda df, p, c: labels.label_filter(df, c.label, p.get("substring", ""), c.separator),
    "cap_per_label": lambda df, p, c: _counted(df, labels.cap_per_label(df, c.row, c.label, int(p.get("cap", 0)), c.separator)),
    "markup": lambda df, p, c: labels.markup_filter(df, c.text),
    "pii": lambda df, p, c: labels.pii_filter(df, c.text, p.get("mode", "mask")),
}
_TABLE = {
    "rules": lambda df, p, c: rules.filter_rows(df, p.get("rules") or [], p.get("combine", "and")),
    "select_columns": lambda df, p, c: _counted(df, columns.select_columns(df, list(p.get("keep") or []))),
    "drop_columns": lambda df, p, c: _counted(df, columns.drop_columns(df, list(p.get("drop") or []))),
    "rename_columns": lambda df, p, c: _counted(df, columns.rename_columns(df, dict(p.get("mapping") or {}))),
    "dedupe_keys": lambda df, p, c: _counted(df, keys.dedupe_keys(df, list(p.get("keys") or []), c.row, p.get("keep", "first"))),
}
NAMES = sorted({**_FILTERS, **_TABLE})


# Rows that an operation's report shows, and characters of each.
EXAMPLES, EXAMPLE_CHARS = 5, 120


def examples(name: str, before: DataFrame, after: DataFrame, ctx: Context) -> DataFrame:
    """(row, removed, before, after): the first rows that an operation removed, or else changed, as its report shows them.

    Operations on columns have none.
    """
    key = F.col(f"`{ctx.row}`")
    nothing = F.lit(None).cast("string")
    if name.endswith("_columns") or ctx.row not in after.columns:
        return before.limit(0).select(key.alias("row"), nothing.alias("removed"), nothing.alias("before"), nothing.alias("after"))
    shown = combined_text(ctx.text) if ctx.text and name != "rules" else F.concat_ws(" | ", *[cell(c) for c in before.columns])
    gone = before.join(after.select(key.alias("_kept")), key == F.col("_kept"), "left_anti")
    gone = gone.select(key.alias("row"), F.substring(shown, 1, EXAMPLE_CHARS).alias("removed"), nothing.alias("before"), nothing.alias("after"))
    if name not in ("markup", "pii"):
        return gone.orderBy("row").limit(EXAMPLES)
    left = before.select(key.alias("row"), F.array(*[cell(c) for c in ctx.text]).alias("a"))
    both = left.join(after.select(key.alias("row"), F.array(*[cell(c) for c in ctx.text]).alias("b")), "row").where("a <> b")
    pair = F.get(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] != x["b"]), F.lit(0))
    cut = [F.substring(pair[c], 1, EXAMPLE_CHARS).alias(n) for c, n in (("a", "before"), ("b", "after"))]
    return gone.unionByName(both.select("row", nothing.alias("removed"), *cut)).orderBy("row").limit(EXAMPLES)


def run(name: str, df: DataFrame, params: dict | None = None, ctx: Context | None = None) -> OpResult:
    """The operation `name` on a table; nothing is computed but what its checks need."""
    if name in _TABLE:
        return _TABLE[name](df, params or {}, ctx or Context(row=df.columns[0]))
    if name not in _FILTERS:
        raise ValueError(f"Unknown operation {name!r}; there are {', '.join(NAMES)}.")
    if ctx is None:
        raise ValueError(f"The operation {name!r} needs the table's text and label columns.")
    missing = [c for c in (*ctx.text, ctx.label) if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}.")
    return _FILTERS[name](df, params or {}, ctx)


def apply(store, source: str, name: str, params: dict | None = None, ctx: Context | None = None, target: str | None = None, overwrite: bool = False) -> dict:
    """Run an operation on a saved dataset: without a target a preview that writes nothing, else saved with its history."""
    made = run(name, store.load(source), params, ctx)
    stats = made.stats.first().asDict()
    if ctx is not None:
        told = examples(name, store.load(source), made.df, ctx).collect()
        stats["examples"] = [{k: v for k, v in r.asDict().items() if k != "row" and v is not None} for r in told]
    if target is None:
        return {"filter": name, **stats, "preview": True}
    store.save(made.df, target, source, {"filter": name, "params": params or {}, **stats}, overwrite)
    return {"filter": name, **stats, "preview": False}
