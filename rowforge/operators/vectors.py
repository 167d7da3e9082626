"""Cosine similarity: exact blocked search, leakage gate, semantic deduplication, exact search over banded blocks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import name
from rowforge.operators.greedy import first_independent
from rowforge.session import settle


def unit(vector: Column | str) -> Column:
    """The vector in double precision at length 1; a zero vector stays zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    # The length is bound once by way of a one-element array; inside the inner lambda it would be summed anew.
    bound = F.array(F.struct(wide.alias("v"), length.alias("n")))
    scaled = F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def encode_texts(df: DataFrame, text: Column, encode, into: str = "vector") -> DataFrame:
    """Add vectors by an injected function list of texts -> matrix, called on Arrow batches by the executors."""

    @F.pandas_udf("array<float>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(batch.fillna("").tolist()), dtype=np.float32)), index=batch.index)

    return df.withColumn(into, of(text))


BLOCK = 4096


def _parts(df: DataFrame, blocks: int | None) -> int:
    """Blocks of about BLOCK rows."""
    return blocks or max(1, -(-df.count() // BLOCK))


def _blocks(df: DataFrame, key: str, vector: str, blocks: int) -> DataFrame:
    return df.select(name(key).cast("long").alias("id"), unit(name(vector)).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _products(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for all a < b at or above `threshold`, each pair of blocks one matrix product.

    `left` has (i, j, id, v, block), a copy of each row for each pair (i, j) of blocks whose first is its own; `right`
    has (k, l, id2, w, home) of the second ones.
    """
    schema = "a long, b long, similarity double"

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["w"].to_numpy())
        out = []
        for low in range(0, len(x), 1024):
            near = x[low : low + 1024] @ y.T
            i, j = np.nonzero(near >= threshold)
            out.append(pd.DataFrame({"a": left["id"].to_numpy()[i + low], "b": right["id2"].to_numpy()[j], "similarity": near[i, j]}))
        found = pd.concat(out)
        if left["block"].iloc[0] != right["home"].iloc[0]:
            low, high = np.minimum(found["a"], found["b"]), np.maximum(found["a"], found["b"])
            found = pd.DataFrame({"a": low, "b": high, "similarity": found["similarity"]})
        return found[found["a"] < found["b"]]

    left = left.select("i", "j", "id", "v", "block")
    right = right.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("id").alias("id2"), F.col("v").alias("w"), F.col("block").alias("home"))
    return left.groupBy("i", "j").cogroup(right.groupBy("k", "l")).applyInPandas(product, schema)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity) for all a < b at or above `threshold`: each pair of blocks is one matrix product.

    Every row makes its own copies, one for each block from its own on and one for each up to it; there is no list of pairs.
    """
    blocks = _parts(df, blocks)
    rows = _blocks(df, key, vector, blocks)
    left = rows.withColumns({"i": F.col("block"), "j": F.explode(F.sequence(F.col("block"), F.lit(blocks - 1)))})
    right = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("block"))), "j": F.col("block")})
    return _products(left, right, threshold)


#: Numbers in all vectors of a reference that is sent to every task: 64 MB of doubles.
SENT = 1 << 23
#: Numbers in the vectors of a block of rows or references that a task compares: 16 MB of doubles.
GRID = 1 << 21


def _best(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest product of each row of x with any of y, by pieces whose products take 32 MB; 0 at least."""
    best = np.zeros(len(x))
    for low in range(0, len(x), 1024):
        for other in range(0, len(y), 4096):
            near = x[low : low + 1024] @ y[other : other + 4096].T
            best[low : low + 1024] = np.maximum(best[low : low + 1024], near.max(axis=1))
    return best


def _matrix(vectors: DataFrame) -> np.ndarray:
    """The vectors of the one column of a table of bounded size, on the driver."""
    column = vectors.toArrow().column(0).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_match(df: DataFrame, key: str, vector: str, reference: DataFrame, ref_vector: str, blocks: int | None = None) -> DataFrame:
    """(id, similarity): the largest cosine of each row to any reference vector; 0 without references.

    A reference of at most SENT numbers goes to every task and the rows stay where they are; a larger one is compared
    by blocks of at most about GRID numbers of either side, so that few copies of a row are shuffled.
    """
    unit_reference = reference.select(unit(name(ref_vector)).alias("v")).where("v is not null")
    size = unit_reference.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers"), F.count("*").alias("n")).first()
    if size["numbers"] <= SENT and blocks is None:
        shared = df.sparkSession.sparkContext.broadcast(_matrix(unit_reference))

        def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                against = shared.value
                best = _best(np.stack(part["v"].to_numpy()), against) if len(part) and len(against) else np.zeros(len(part))
                yield pd.DataFrame({"id": part["id"], "similarity": best})

        asked = df.select(name(key).cast("long").alias("id"), unit(name(vector)).alias("v")).where("id is not null and v is not null")
        return asked.mapInPandas(nearest, "id long, similarity double")
    each = max(1, GRID * size["n"] // max(size["numbers"], 1))
    parts, blocks = blocks or -(-size["n"] // each) or 1, blocks or -(-df.count() // each) or 1
    rows = _blocks(df, key, vector, blocks)
    numbered = unit_reference.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    against = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        best = _best(np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())) if len(right) else np.zeros(len(left))
        return pd.DataFrame({"id": left["id"].to_numpy(), "similarity": best})

    found = spread.groupBy("block", "part").cogroup(against.groupBy("block", "part")).applyInPandas(product, "id long, similarity double")
    return found.groupBy("id").agg(F.max("similarity").alias("similarity"))


def leakage_gate(df: DataFrame, key: str, vector: str, reference: DataFrame, ref_vector: str, threshold: float = 0.9) -> DataFrame:
    """The rows whose best cosine to the reference is below `threshold`."""
    near = best_match(df, key, vector, reference, ref_vector).where(F.col("similarity") >= threshold).select(F.col("id").alias("_near_id"))
    return df.join(near, name(key).cast("long") == F.col("_near_id"), "left_anti")


def dedupe_semantic(df: DataFrame, key: str, vector: str, threshold: float = 0.95, batch: int | None = None) -> DataFrame:
    """In key order, the rows without a cosine of `threshold` or more to an earlier kept row.

    Rows are decided in stretches of the key, of vectors with about SENT / 2 numbers together or of `batch` rows. Only
    within a stretch are all pairs made; the rows that it keeps go to every task and drop those like them of all later
    stretches where these stand, so that links between dropped rows are never made and memory and shuffles of a stretch
    are bounded however many rows there are. Rows of a null vector have no links.
    """
    if threshold <= 0:
        return df.limit(0)
    context = df.sparkSession.sparkContext
    rows = df.select(name(key).cast("long").alias("id"), unit(name(vector)).alias("v")).where("id is not null")
    kept = rows.where("v is null").select("id")
    left = rows.where("v is not null")
    size = left.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    batch = batch or max(BLOCK, SENT // 2 * size["n"] // max(size["numbers"], 1))
    n = size["n"]
    while n:
        last = n <= batch
        bound = None if last else left.agg(F.percentile_approx("id", batch / n, 10_000)).first()[0]
        part = left if last else left.where(F.col("id") <= F.lit(bound))
        found = settle(first_independent(part.select("id"), similar_pairs(part, "id", "v", threshold).select("a", "b")))
        kept = kept.unionByName(found)
        if last:
            break
        shared = context.broadcast(_matrix(part.join(found, "id", "left_semi").select("v")))  # a stretch at most

        def unlike(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for some in parts:
                yield some[_best(np.stack(some["v"].to_numpy()), shared.value) < threshold] if len(some) else some

        left = settle(left.where(F.col("id") > F.lit(bound)).mapInPandas(unlike, "id long, v array<double>"))
        n = left.count()
    return df.join(kept.withColumnRenamed("id", "_kept_id"), name(key).cast("long") == F.col("_kept_id"), "left_semi")


#: Rows drawn for each banded block to find where it begins.
SAMPLE = 64
#: Angle in radians that rounding may add to or take from a bound.
SLACK = 1e-6


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


#: Blocks whose bounds are compared in one task with as many others.
BALLS = 2048


def near_blocks(balls: DataFrame, threshold: float, group: int = BALLS) -> DataFrame:
    """(i, j), i <= j, of the blocks that may hold a pair at or above `threshold`, from (block, center, radius).

    Angles obey the triangle inequality, so two blocks whose centers lie farther apart than both radii and the
    threshold's angle hold none. Blocks are compared on the executors, `group` with `group` others at a time.
    """
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK
    rows = balls.withColumn("part", F.floor(F.col("block") / group).cast("int"))
    parts = rows.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"i": np.zeros(0, np.int32), "j": np.zeros(0, np.int32)})
        apart = _angles(np.stack(left["center"]), np.stack(right["center_"])) - left["radius"].to_numpy()[:, None] - right["radius_"].to_numpy()
        one, other = np.nonzero(apart <= reach)
        found = pd.DataFrame({"i": left["block"].to_numpy()[one], "j": right["block_"].to_numpy()[other]})
        return found[found["i"] <= found["j"]]

    left = rows.withColumn("other", F.explode(F.sequence(F.col("part"), F.lit(max(parts, 1) - 1))))
    right = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part")))).toDF(*[f"{c}_" for c in (*rows.columns, "other")])
    # A task has the pairs of the groups (part, other) on the left and (other_, part_) on the right.
    return left.groupBy("part", "other").cogroup(right.groupBy("other_", "part_")).applyInPandas(near, "i int, j int")


def banded_pairs(
    df: DataFrame, key: str, vector: str, dims: int, threshold: float, bands: int = 24, bits: int = 6, seed: int = 1, blocks: int | None = None
) -> DataFrame:
    """(a, b, similarity) for all a < b at or above `threshold`, as similar_pairs(); rows of a null key or vector have none.

    The signs of random projections, `bands` of `bits` each, order the rows: a code with too many rows is divided by
    the next band, and equal signatures by the key. Stretches of that order, cut at places drawn from a sample, are
    the blocks, so that like vectors share one. Only pairs of blocks that a bound on their angles excludes are left out;
    which these are is found on the executors, and the rows are joined with the others. The driver holds where blocks
    begin, a signature for each.
    """
    planes = np.random.default_rng(seed).standard_normal((bands * bits, dims))

    def places(part: pd.DataFrame) -> list[bytes]:
        signs = np.packbits(np.stack(part["v"].to_numpy()) @ planes.T > 0, axis=1)
        return [row.tobytes() + (i + (1 << 63)).to_bytes(8, "big") for row, i in zip(signs, part["id"].tolist(), strict=True)]

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (pd.DataFrame({"place": places(part)}) for part in parts if len(part))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (part.assign(block=[bisect_right(bounds, p) for p in places(part)]) for part in parts if len(part))

    rows = df.select(name(key).cast("long").alias("id"), unit(name(vector)).alias("v")).where("id is not null and v is not null")
    count = rows.count()
    blocks = blocks or max(1, -(-count // BLOCK))
    drawn = rows.sample(min(1.0, SAMPLE * blocks / max(count, 1)), seed) if blocks > 1 else rows.limit(0)
    drawn = sorted(bytes(r[0]) for r in drawn.mapInPandas(placed, "place binary").collect())
    bounds = [drawn[len(drawn) * i // blocks] for i in range(1, blocks)] if drawn else []

    def ball(block: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(block["v"].to_numpy())
        center = v.sum(axis=0)
        center = center / (np.linalg.norm(center) or 1.0)
        return pd.DataFrame({"block": [block["block"].iloc[0]], "center": [center], "radius": [_angles(v, center[None, :]).max()]})

    rows = settle(rows.mapInPandas(dealt, "id long, v array<double>, block int"))
    balls = settle(rows.groupBy("block").applyInPandas(ball, "block int, center array<double>, radius double"))
    pairs = settle(near_blocks(balls, threshold))
    left = rows.join(pairs.withColumn("block", F.col("i")), "block")
    right = rows.join(pairs.withColumn("block", F.col("j")), "block")
    return _products(left, right, threshold)
