"""Keys that very many rows share, and an equi-join that deals such rows to many tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps, and the most that are taken from it: any value of a thousandth of the rows is among them.
TRACKED, MOST = 16_384, 1_000
#: Rows that a sketch looks at in expectation: a value of a thousandth of the rows has a hundred of them.
SKETCHED = 100_000
#: Rows that one key may bring to a task before they are divided.
PIECE_ROWS = 200_000


@dataclass(frozen=True)
class Frequent:
    """The number of rows, and the values that very many of them share."""

    rows: int
    values: list[str]


def frequent(df: DataFrame, value: Column, least: int, most: int = MOST) -> Frequent:
    """Values (texts) that `least` rows share, and at least one in `most`, by a mergeable sketch of a sample.

    Two passes over the column without a shuffle of rows: a count, and where it reaches `least` a sketch of TRACKED
    counters in every task. Values near the limit may be missed or taken; what is built on them must be right for any list.
    """
    n = df.count()
    if n < least:
        return Frequent(n, [])
    rate = min(1.0, SKETCHED / n)
    drawn = df.sample(rate, seed=1) if rate < 1 else df
    top = drawn.select(value.alias("v")).where("v is not null").agg(F.expr(f"approx_top_k(v, {most}, {TRACKED})").alias("top")).first()["top"]
    return Frequent(n, sorted(t["item"] for t in top if t["count"] >= rate * max(least, n / most)))


def heavy_keys(left: DataFrame, right: DataFrame, key: str, text: Column, piece_rows: int = PIECE_ROWS) -> DataFrame | None:
    """(key, pieces_l, pieces_r, both) of the keys that more than `piece_rows` rows of a side share; None without any.

    `key` is a column of both sides, null where it is unusable; `text` makes a text of it. Candidates come from a sketch
    of each side, their counts from a second pass over their rows alone. The table has no more than a few thousand rows.
    """
    found = [frequent(side, text, piece_rows) for side in (left, right)]
    candidates = sorted({v for f in found for v in f.values})
    if not candidates:
        return None
    piece = max(piece_rows, max(f.rows for f in found) // MOST)  # no key is cut into more than MOST pieces
    counted = [side.where(text.isin(candidates)).groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n)) for side, n in ((left, "l"), (right, "r"))]
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / piece)).cast("int")
    both = counted[0].join(counted[1], "k", "full_outer")
    table = both.select("k", pieces("l").alias("pieces_l"), pieces("r").alias("pieces_r"), (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))
    rows = table.where("pieces_l > 1 or pieces_r > 1").collect()
    return left.sparkSession.createDataFrame(rows, table.schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, text, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """left joined with right on left_key = right_key (`how` as Spark names it), with the columns of both.

    A null key matches nothing; its rows go past the shuffle. A heavy key's rows are dealt into pieces on each side, and
    every piece is copied once for each piece of the other side, so that each pair of rows meets in exactly one task: a
    grid of tasks shares what one would get. Where a heavy key is on both sides all its rows have partners, so a copy
    that finds an empty piece opposite is dropped; where it is on one side only, it is not copied. Rows repeated whole
    are dealt by the partition they come from too. `text` makes a text of a key column.
    """
    lone = []
    for side, key, needed in ((left, left_key, ("left", "full_outer")), (right, right_key, ("right", "full_outer"))):
        if how in needed:
            lone.append(side.where(F.col(key).isNull()))
    heavy = heavy_keys(left.withColumnRenamed(left_key, "_key"), right.withColumnRenamed(right_key, "_key"), "_key", text(F.col("_key")), piece_rows)
    left, right = left.where(F.col(left_key).isNotNull()), right.where(F.col(right_key).isNotNull())
    on = F.col(left_key) == F.col(right_key)
    names = [*left.columns, *right.columns]
    if heavy is None:
        joined = left.join(right, on, how)
    else:

        def dealt(side: DataFrame, key: str, own: str, other: str, mark: str) -> DataFrame:
            known = heavy.select(F.col("k").alias(f"{mark}_k"), F.col(f"pieces_{own}").alias("own"), F.col(f"pieces_{other}").alias("other"), F.col("both").alias(f"{mark}_both"))
            out = side.join(F.broadcast(known), F.col(key) == F.col(f"{mark}_k"), "left")  # a few thousand rows at most
            piece = F.pmod(F.xxhash64(*side.columns, F.spark_partition_id()), F.coalesce("own", F.lit(1))).cast("int")
            copies = F.when(F.col("other") > 1, F.sequence(F.lit(0), F.col("other") - 1)).otherwise(F.array(F.lit(0)))
            places = (piece, F.explode(copies)) if own == "l" else (F.explode(copies), piece)
            return out.select(*side.columns, f"{mark}_both", *[p.alias(f"{mark}_{i}") for p, i in zip(places, "ij", strict=True)])

        a, b = dealt(left, left_key, "l", "r", "_a"), dealt(right, right_key, "r", "l", "_b")
        joined = a.join(b, on & (F.col("_a_i") == F.col("_b_i")) & (F.col("_a_j") == F.col("_b_j")), how)
        empty = (F.coalesce("_a_both", F.lit(False)) & F.col(right_key).isNull()) | (F.coalesce("_b_both", F.lit(False)) & F.col(left_key).isNull())
        joined = joined.where(~empty).select(*names)
    for rows in lone:
        joined = joined.unionByName(rows, allowMissingColumns=True)
    return joined
