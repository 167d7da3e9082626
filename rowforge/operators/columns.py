"""Choice, removal and renaming of columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from rowforge.functions.text import name


def _known(df: DataFrame, names: list[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"Unknown column {', '.join(map(repr, unknown))}; there are {', '.join(df.columns)}.")


def select_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only these columns, in this order."""
    twice = [n for n, k in Counter(keep).items() if k > 1]
    if not keep or twice:
        raise ValueError(f"Columns named twice: {twice}." if twice else "Name at least one column to keep.")
    _known(df, keep)
    return df.select(*[name(n) for n in keep])


def drop_columns(df: DataFrame, drop: list[str]) -> DataFrame:
    """All but these columns."""
    if not drop:
        raise ValueError("Name at least one column to drop.")
    _known(df, drop)
    left = [n for n in df.columns if n not in set(drop)]
    if not left:
        raise ValueError("At least one column has to remain.")
    return df.select(*[name(n) for n in left])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """New names, trimmed; a column may keep its own."""
    if not mapping:
        raise ValueError("Name at least one column to rename.")
    _known(df, list(mapping))
    blank = [old for old, new in mapping.items() if not str(new).strip()]
    if blank:
        raise ValueError(f"The new name is empty for {', '.join(map(repr, blank))}.")
    after = [str(mapping.get(n, n)).strip() if n in mapping else n for n in df.columns]
    clash = [n for n, k in Counter(after).items() if k > 1]
    if clash:
        raise ValueError(f"Name already taken: {', '.join(map(repr, clash))}.")
    return df.select(*[name(old).alias(new) for old, new in zip(df.columns, after, strict=True)])
