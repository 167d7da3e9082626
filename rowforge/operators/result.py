"""What an operation returns: the new table and one lazy row of statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class OpResult:
    """`stats` is computed only when somebody reads it."""

    df: DataFrame
    stats: DataFrame
