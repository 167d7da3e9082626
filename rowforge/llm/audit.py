"""Filter interaction audit over failing-id relations.

Each filter's failing rows are stored as a table of row ids. The survivors of a prefix of filters are the survivors of
the shorter prefix without the failing ids (left-anti join); what the next filter removes are those survivors that are
among its failing ids (left-semi join). What survives or goes does not depend on the order within a prefix, so all
orders share one tree of such joins: level by level, the semi join gives the rows that a filter fails, the anti join
those it passes, and both go on. Ids of labelled rows divide the leaves once more. Counts of the leaves, at most two to
the number of filters and labels for each part, then hold every prefix of every order: its survivors, removals,
redundancies and label losses are sums over leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.common import by_bytes, settle_table, worker_memory

# Limits of the five text filters and the characters they count.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
#: Bytes of texts that are measured together; a longer text comes alone.
CHUNK = 4 << 20
#: Filters of an audit at most: its result has a row for each order and step.
MOST_FILTERS = 6


def failures(text: str | None) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails filters A to D; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITALS_PERCENT * len(text or ""),
        len(raw) != len(raw.translate(None, SYMBOLS)),
    )


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """A stored table of (row, doc_id, part, a, b, c, d, digest): what filters A to D say of every row.

    row is a number of the table's own, so that repeated and null ids stay apart; digest has 128 bits of the text.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("audit")
        for batch in by_bytes(batches, -1, CHUNK):
            texts = batch.column(2).to_pylist()
            flags = list(zip(*map(failures, texts), strict=True)) or [()] * 4
            digests = pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(f, pa.bool_()) for f in flags], digests], names=["doc_id", "part", "a", "b", "c", "d", "digest"]
            )

    made = rows.mapInArrow(run, "doc_id long, part string, a boolean, b boolean, c boolean, d boolean, digest binary")
    return settle_table(made.withColumn("row", F.monotonically_increasing_id()))


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """A stored table of failing row ids for each of the filters A to E, from measured().

    E fails a row whose text is that of a row with a smaller doc_id; a null id is neither smaller nor larger than another.
    """
    several = settle_table(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    again = rows.select("row", "doc_id", "digest").join(several, "digest").where("doc_id > first").select("row")
    found = {name.upper(): rows.where(name).select("row") for name in "abcd"} | {"E": again}
    return {name: settle_table(ids) for name, ids in found.items()}


def marked_ids(rows: DataFrame, labels: DataFrame, mark: Column) -> DataFrame:
    """A stored table of the ids of rows whose doc_id has a label row that bears the mark; null ids have none."""
    named = labels.where(mark).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return settle_table(rows.where("doc_id is not null").select("row", "doc_id").join(named, "doc_id", "left_semi").select("row"))


def divide(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(part, cell, n) of the rows: bit i of a cell says that table i holds the row's id."""
    left = rows.select("row", "part", F.lit(0).alias("cell"))
    for i, ids in enumerate(tables):
        holds = left.join(ids, "row", "left_semi").withColumn("cell", F.col("cell").bitwiseOR(F.lit(1 << i)))
        left = holds.unionByName(left.join(ids, "row", "left_anti"))
        left = settle_table(left) if i + 1 < len(tables) else left
    return left.groupBy("part", "cell").agg(F.count("*").alias("n"))


def audit(rows: DataFrame, failing: dict[str, DataFrame], losses: dict[str, DataFrame]) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, each loss, shapley.

    `rows` has row (unique) and part, `failing` a table of failing row ids for each filter by its letter, `losses` a
    table of row ids for each further column that counts what a step removes of them. A part has rows for all orders,
    zeros included; an empty table has no parts and gives an empty result. There are MOST_FILTERS filters at most.
    """
    letters = list(failing)
    if not letters or len(letters) > MOST_FILTERS:
        raise ValueError(f"An audit takes 1 to {MOST_FILTERS} filters.")
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    whole = (1 << len(letters)) - 1
    cells = divide(rows, [*failing.values(), *losses.values()])

    # One row for each filter and set of filters before it; so many orders begin like that.
    sets = [(b, before, factorial(before.bit_count()) * factorial(len(letters) - 1 - before.bit_count())) for b in bit.values() for before in range(whole + 1) if not before & b]
    listed = F.array(*[F.struct(F.lit(b).alias("filter"), F.lit(before).alias("before"), F.lit(many).cast("long").alias("orders")) for b, before, many in sets])
    each = cells.withColumn("s", F.explode(listed)).select("part", "cell", "n", "s.*")
    cell = F.col("cell")
    fails, earlier = cell.bitwiseAND(F.col("filter")) != 0, cell.bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    marks = {name: cell.bitwiseAND(F.lit(1 << (len(letters) + i))) != 0 for i, name in enumerate(losses)}
    steps = each.groupBy("part", "filter", "before", "orders").agg(
        count(~fails & ~earlier).alias("kept"), count(removed).alias("removed"), count(fails & earlier).alias("redundant"),
        count(cell.bitwiseAND(F.lit(whole)) == F.col("filter")).alias("unique_fails"), *[count(removed & has).alias(name) for name, has in marks.items()],
    )
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))

    listing = []
    for order in permutations(letters):
        before = 0
        for i, letter in enumerate(order):
            listing.append(("".join(order), i + 1, bit[letter], before))
            before |= bit[letter]
    orders = rows.sparkSession.createDataFrame(listing, "filter_order string, step int, filter int, before int")
    return steps.join(orders, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *losses, "shapley"
    )


def audit_texts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """The audit of the text filters A to E in every order, with good_lost and toxic_lost from the labels.

    A null text counts as empty and a null part as the empty string. Repeated rows each count; of rows with equal texts
    those behind the smallest doc_id fail E, and rows with that doc_id or none do not. A document is good or toxic if any
    of its label rows says so. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = measured(docs, text, doc_id, part)
    marks = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return audit(rows, failing_ids(rows), {name: marked_ids(rows, labels, mark) for name, mark in marks.items()})
