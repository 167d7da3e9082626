"""Composite keys, duplicates by key, and joins with a forecast of their size.

A key is usable only if all its parts are filled. An unusable key is null here, and null never equals
anything in an equi-join or counts as a duplicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.text import cell, name, strip
from rowforge.operators.heavy import PIECE_ROWS, spread_join
from rowforge.operators.result import OpResult

MAX_ROWS = 5_000_000


def _require(df: DataFrame, columns: list[str]) -> None:
    if not columns:
        raise ValueError("Choose at least one key column.")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown key column {', '.join(map(repr, unknown))}; there are {', '.join(df.columns)}.")


def key(columns: list[str]) -> Column:
    """The trimmed parts as a struct; null where one is empty."""
    parts = [strip(cell(c)) for c in columns]
    filled = reduce(lambda a, b: a & b, [p != "" for p in parts])
    return F.when(filled, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def key_text(of: Column) -> Column:
    """The parts of a key() as one text, by which its rows are counted."""
    return F.when(of.isNotNull(), F.to_json(of))


def duplicate_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, unique_keys, empty_key_rows, duplicate_groups, duplicate_rows, removable_rows."""
    _require(df, columns)
    counts = df.groupBy(key(columns).alias("k")).count()
    n, usable = F.col("count"), F.col("k").isNotNull()
    again = usable & (n > 1)
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.count_if(usable).alias("unique_keys"),
        F.coalesce(F.sum(F.when(~usable, n)), F.lit(0)).alias("empty_key_rows"),
        F.count_if(again).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(again, n)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(again, n - 1)), F.lit(0)).alias("removable_rows"),
    )


def duplicate_examples(df: DataFrame, columns: list[str], examples: int = 5) -> DataFrame:
    """The keys that repeat most, with their counts; ties by key."""
    _require(df, columns)
    counts = df.groupBy(key(columns).alias("k")).count().where("k is not null and count > 1")
    top = counts.orderBy(F.desc("count"), "k").limit(examples)
    return top.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(columns)], "count")


def dedupe_keys(df: DataFrame, columns: list[str], order: str, keep: str = "first") -> DataFrame:
    """One row of each usable key, the first or last by `order`; rows without a usable key all stay."""
    _require(df, columns)
    if keep not in ("first", "last"):
        raise ValueError(f"Unknown keep mode {keep!r}; use 'first' or 'last'.")
    keyed = df.withColumn("_key", key(columns))
    by = name(order).asc() if keep == "first" else name(order).desc()
    ranked = keyed.where("_key is not null").withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(by)))
    free = keyed.where("_key is null").drop("_key")  # they never enter the shuffle
    return ranked.where("_n = 1").drop("_key", "_n").unionByName(free)


def cardinality(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """One row on how two key sets relate and how many rows an inner join has, from counts by key alone."""
    _require(left, [a for a, _ in keys])
    _require(right, [b for _, b in keys])
    big = "decimal(38,0)"
    a = left.groupBy(key([a for a, _ in keys]).alias("k")).agg(F.count("*").cast(big).alias("l"))
    b = right.groupBy(key([b for _, b in keys]).alias("k")).agg(F.count("*").cast(big).alias("r"))
    both = a.join(b, "k", "full_outer")
    zero = F.lit(0).cast(big)
    usable = F.col("k").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), zero).cast("long")

    inner = usable & F.col("l").isNotNull() & F.col("r").isNotNull()
    summed = both.agg(
        total(F.col("l")).alias("left_rows"),
        total(F.col("r")).alias("right_rows"),
        F.count_if(usable & F.col("l").isNotNull()).alias("left_unique_keys"),
        F.count_if(usable & F.col("r").isNotNull()).alias("right_unique_keys"),
        F.coalesce(F.max(F.when(usable, F.col("l"))), zero).cast("long").alias("left_max_repeat"),
        F.coalesce(F.max(F.when(usable, F.col("r"))), zero).cast("long").alias("right_max_repeat"),
        total(F.when(~usable, F.col("l"))).alias("left_unusable_key_rows"),
        total(F.when(~usable, F.col("r"))).alias("right_unusable_key_rows"),
        total(F.when(~inner, F.col("l"))).alias("left_unmatched_rows"),
        total(F.when(~inner, F.col("r"))).alias("right_unmatched_rows"),
        F.count_if(inner).alias("matching_keys"),
        F.count_if(usable & F.col("l").isNotNull() & F.col("r").isNull()).alias("left_only_keys"),
        F.count_if(usable & F.col("r").isNotNull() & F.col("l").isNull()).alias("right_only_keys"),
        total(F.when(inner, F.col("l") * F.col("r"))).alias("estimated_rows"),
    )
    many = lambda side: F.when(F.col(f"{side}_max_repeat") > 1, "many").otherwise("one")
    return summed.withColumn("relation", F.concat_ws("-to-", many("left"), many("right"))).withColumn(
        "explodes", F.col("estimated_rows") > F.greatest("left_rows", "right_rows")
    )


def unmatched(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The left rows that no right row matches."""
    a, b = key([a for a, _ in keys]), key([b for _, b in keys])
    known = right.select(b.alias("_k")).where("_k is not null").distinct()
    return left.withColumn("_k", a).join(known, "_k", "left_anti").drop("_k")


def join_tables(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "left", suffix: str = "_right",
    coalesce: bool = False, max_rows: int | None = MAX_ROWS, piece_rows: int | None = PIECE_ROWS,
) -> OpResult:
    """Equi-join of two text tables; unmatched cells are empty, the left key is filled from the right one.

    A column that both have gets the suffix on the right, or with `coalesce` fills the left's empty cells.
    A join with more rows than `max_rows` is refused before it runs; None skips the forecast. Rows with an unusable key
    are never shuffled, and a key that over `piece_rows` rows share is dealt to many tasks (None: neither is done).
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"Unknown join type {how!r}.")
    forecast = cardinality(left, right, keys)
    extra = F.lit(0)
    if how in ("left", "outer"):
        extra = extra + F.col("left_unmatched_rows")
    if how in ("right", "outer"):
        extra = extra + F.col("right_unmatched_rows")
    stats = forecast.withColumn("expected_rows", F.col("estimated_rows") + extra)
    if max_rows is not None:
        found = stats.first()
        if found["expected_rows"] > max_rows:
            raise ValueError(
                f"The join would have {found['expected_rows']} rows, over the limit of {max_rows}; its key repeats up to "
                f"{found['left_max_repeat']} and {found['right_max_repeat']} times. Add a key column."
            )
    right_keys = [b for _, b in keys]
    a = left.select(*[cell(c).alias(f"l{i}") for i, c in enumerate(left.columns)], key([a for a, _ in keys]).alias("_lk"))
    b = right.select(*[cell(c).alias(f"r{i}") for i, c in enumerate(right.columns)], key(right_keys).alias("_rk"))
    kind = {"outer": "full_outer"}.get(how, how)
    if piece_rows is None:
        joined = a.join(b, F.col("_lk") == F.col("_rk"), kind)
    else:
        joined = spread_join(a, b, "_lk", "_rk", kind, key_text, piece_rows)
    of_left = {c: F.coalesce(F.col(f"l{i}"), F.lit("")) for i, c in enumerate(left.columns)}
    of_right = {c: F.coalesce(F.col(f"r{i}"), F.lit("")) for i, c in enumerate(right.columns)}
    for x, y in keys:
        of_left[x] = F.when(of_left[x] != "", of_left[x]).otherwise(of_right[y])
    out = dict(of_left)
    for c, value in of_right.items():
        if c in right_keys:
            continue
        if c not in of_left:
            out[c] = value
        elif coalesce:
            out[c] = F.when(of_left[c] != "", of_left[c]).otherwise(value)
        else:
            out[c + suffix] = value
    return OpResult(joined.select(*[v.alias(c) for c, v in out.items()]), stats)
