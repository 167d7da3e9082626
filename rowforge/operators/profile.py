"""Column profiles in one melt: fill rates, distinct values, common values, numeric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.text import cell, name, number, strip
from rowforge.operators.heavy import MOST, TRACKED
from rowforge.operators.ranks import percentiles
from rowforge.session import settle

NUMERIC_SHARE = 0.8


def _melted(df: DataFrame) -> DataFrame:
    """(column, value) of every cell, stripped."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), strip(cell(c)).alias("value")) for i, c in enumerate(df.columns)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def value_counts(df: DataFrame) -> DataFrame:
    """(position, column, value, n): the only shuffle of the cells, behind a partial count."""
    return _melted(df).groupBy("position", "column", "value").agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame) -> DataFrame:
    """A row for each column: filled, empty, fill_rate, distinct, kind."""
    filled = F.col("value") != ""
    by = value_counts(df).groupBy("position", "column").agg(
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("empty"),
        F.count_if(filled).alias("distinct"),
        F.coalesce(F.sum(F.when(filled & number(F.col("value")).isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"),
    )
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("parsed") >= NUMERIC_SHARE * F.col("filled"), "numeric").otherwise("text")
    rate = F.round(F.col("filled") / (F.col("filled") + F.col("empty")), 4)
    return by.select("position", "column", "filled", "empty", rate.alias("fill_rate"), "distinct", kind.alias("kind"))


#: Share of the rows by which a sketch of that many counters may be wrong, with a margin.
SKETCH_ERROR = 7 / TRACKED


def top_values(df: DataFrame, top_n: int = 10) -> DataFrame:
    """The most common values of each column; ties by value.

    One pass keeps a sketch of each column; a second counts its candidates exactly. Where the last of the top has more
    rows than a value outside of the sketch can have, that is the answer, and no value of the column was shuffled. Only
    columns without such common values are counted in full.
    """
    rows = df.count()
    sketch = [F.expr(f"approx_top_k(v{i}, {MOST}, {TRACKED})").alias(f"t{i}") for i in range(len(df.columns))]
    held = df.select(*[F.nullif(strip(cell(c)), F.lit("")).alias(f"v{i}") for i, c in enumerate(df.columns)])
    found = held.agg(*sketch).first() if rows > TRACKED else None
    common = {c: [t["item"] for t in found[i] or []] for i, c in enumerate(df.columns)} if found else {}
    counts, rest = None, list(df.columns)
    if any(len(v) >= top_n for v in common.values()):
        some = [c for c in df.columns if len(common[c]) >= top_n]
        wanted = F.array(*[F.struct(F.lit(c).alias("column"), F.when(strip(cell(c)).isin(common[c]), strip(cell(c))).alias("value")) for c in some])
        counts = df.select(F.explode(wanted).alias("c")).where("c.value is not null").groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
        counts = settle(counts)  # no more than MOST rows a column
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
        least = {r["column"]: r["n"] for r in counts.withColumn("p", place).where(F.col("p") == top_n).collect()}
        sure = [c for c in some if least.get(c, 0) > SKETCH_ERROR * rows]
        counts, rest = counts.where(F.col("column").isin(sure)), [c for c in df.columns if c not in sure]
    if rest:
        whole = value_counts(df.select(*[name(c) for c in rest])).where("value <> ''").select("column", "value", "n")
        counts = whole if counts is None else counts.unionByName(whole)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_n).select("column", "rank", "value", F.col("n").alias("count"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """parsed, min, max, mean, median, p05, p95 of the columns of which enough cells are numbers.

    Percentiles interpolate between exact counts by value, of which ranges are looked at by many tasks; `approx` takes
    them from sketches of bounded size in one pass.
    """
    counts = value_counts(df.select(*[name(c) for c in columns or df.columns])).where("value <> ''")
    counts = counts.select("column", number(F.col("value")).alias("x"), "n")
    if not approx:
        counts = settle(counts)  # read for the sums and for the percentiles
    total = F.sum("n").alias("filled")
    parsed = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed")
    shares = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    out = counts.groupBy("column").agg(
        total, parsed, F.min("x").alias("min"), F.max("x").alias("max"),
        (F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"),
        *[F.percentile_approx("x", p).alias(c) for c, p in shares.items() if approx],
    )
    out = out.where(F.col("parsed") >= NUMERIC_SHARE * F.col("filled"))
    if not approx:
        out = out.join(percentiles(counts, ["column"], shares), "column", "left")
    shown = [F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "p05", "p95")]
    return out.select("column", "parsed", *shown)
