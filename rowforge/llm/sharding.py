"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

The key of a record is the hash of its text, so that equal texts lie side by side. Splitters come from a
sample in which a record's chance is in proportion to its size. Ranges that turn out overfull are divided
again by a second hash of the key; a text whose copies alone overfill a range is divided by record. The
resulting pieces, in key order, are laid over the shards by the running sum of their sizes. Equal texts
thus stay in one shard, or in neighbouring ones where a boundary or an overfull group demands it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.common import settle_table, unit_hash

RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
#: A piece is numbered by one task; it holds about this many bytes of text and rows at most.
PIECE_BYTES, PIECE_ROWS = 256 << 20, 1 << 22


def splitters(records: DataFrame, total: int, ranges: int, seed: int) -> list[int]:
    """Boundaries between `ranges` key ranges of near equal size; records has k (the key), id and size.

    The sample has ranges * SAMPLES_PER_RANGE records in expectation and at most about twice that.
    """
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    drawn = records.where(unit_hash("k", "id", seed=seed) < F.col("size") / F.lit(step))
    rows = sorted((r["k"], max(step, float(r["size"]))) for r in drawn.select("k", "size").collect())
    cuts, run, share = [], 0.0, sum(w for _, w in rows) / ranges
    for key, weight in rows:
        run += weight
        if run >= share * (len(cuts) + 1) and len(cuts) < ranges - 1:
            while run >= share * (len(cuts) + 1) and len(cuts) < ranges - 1:
                cuts.append(key)
    return sorted(set(cuts))


def _told_apart(records: DataFrame, heavy: DataFrame) -> DataFrame:
    """The records, with an id of their own for those of `heavy` (k, id): rows repeated whole, too many for one piece.

    They are told apart by the partition that they came from and their number in it.
    """
    apart = records.join(heavy, ["k", "id"], "left_semi").withColumn("pid", F.spark_partition_id())
    apart = settle_table(apart)
    number = F.row_number().over(Window.partitionBy("k", "id", "pid").orderBy(F.lit(0)))
    apart = settle_table(apart.withColumn("id", F.xxhash64("id", "pid", number)).drop("pid"))
    return records.join(heavy, ["k", "id"], "left_anti").unionByName(apart)


def assign(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """Add size, shard (0-based) and slot (gapless from 0 in each shard) to every row.

    Size is the UTF-8 length of the text plus 1; a null text has length 0. Null ids are ordinary keys. Repeated rows
    are separate records that take slots of their own, in several shards where they are more than one should hold;
    which of them takes which is open. Input columns named size, shard or slot are replaced, all others are kept
    whatever their names. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    # Below, columns go by names that the table's own cannot clash with.
    aside = {c: f"own_{i}" for i, c in enumerate(own)}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    records = docs.select(
        *[F.col(f"`{c}`").alias(a) for c, a in aside.items()],
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.xxhash64(body).alias("k"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)).alias("id"),
    )
    shown = [F.col(a).alias(c) for c, a in aside.items()]
    keys = settle_table(records.select("k", "id", "size"))
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return records.select(*shown, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = shards * RANGES_PER_SHARD
    fair = max(1, min(total // ranges, PIECE_BYTES))

    def too_much(size: str, rows: str, times: int = 1):
        return (F.col(size) > F.lit(times * fair)) | (F.col(rows) > F.lit(times * PIECE_ROWS))

    measured = (F.sum("size").alias("b"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("b") / F.lit(fair)), F.ceil(F.col("n") / F.lit(PIECE_ROWS))).cast("long").alias("parts")
    heavy = settle_table(keys.groupBy("k", "id").agg(*measured).where(too_much("b", "n") & (F.col("n") > 1)).select("k", "id"))
    if not heavy.isEmpty():
        records = _told_apart(records, heavy)
        keys = settle_table(records.select("k", "id", "size"))
    cuts = splitters(keys, total, ranges, seed)

    # Texts whose copies alone overfill a range: fewer than total / fair, or rows / PIECE_ROWS, of them.
    hot = settle_table(keys.groupBy("k").agg(*measured).where(too_much("b", "n")).select("k", parts))

    def placed(rows: DataFrame) -> DataFrame:
        within = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
        rows = rows.withColumn("range", F.size(F.filter(within, lambda c: c <= F.col("k"))))
        return rows.join(hot, "k", "left")

    sizes = placed(keys).where("parts is null").groupBy("range").agg(*measured)
    overfull = {r["range"]: r["parts"] for r in sizes.where(too_much("b", "n", 2)).select("range", parts).collect()}
    cut_up = F.lit(1).cast("long")
    if overfull:
        pairs = [F.lit(x) for item in sorted(overfull.items()) for x in item]
        cut_up = F.coalesce(F.create_map(*pairs)[F.col("range")], F.lit(1)).cast("long")

    def pieces(rows: DataFrame) -> DataFrame:
        rows = placed(rows)
        hot_key = F.when(F.col("parts").isNotNull(), F.col("k"))
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.col("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("k", F.lit(seed)), cut_up))
        return rows.withColumn("hot", F.coalesce(hot_key, F.lit(0).cast("long"))).withColumn("part", part)

    piece = ["range", "hot", "part"]
    table = pieces(keys).groupBy(*piece).agg(*measured)
    order = Window.orderBy(*piece)  # one task, over pieces: a few hundred, and one more for each PIECE_BYTES or PIECE_ROWS
    table = table.withColumn("before", F.sum("b").over(order) - F.col("b"))
    middle = (F.col("before") + F.col("b") / 2) * F.lit(shards) / F.lit(total)
    table = table.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    table = table.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy(*piece)) - F.col("n"))
    table = settle_table(table.select(*piece, "shard", "base"))

    rows = pieces(records).join(table, piece)
    slot = F.col("base") + F.row_number().over(Window.partitionBy(*piece).orderBy("k", "id")) - 1
    return rows.withColumn("slot", slot.cast("long")).select(*shown, "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write the rows below path/shard=N, in slot order within each file.

    Nulls, empty and repeated rows and clashing names as in assign(); an empty table writes no shard.
    """
    placed = assign(docs, shards, **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
