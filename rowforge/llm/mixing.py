"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt into blocks by hash, and its blocks are put into a permuted order. Its target says how
often every block is taken, and how many words of one more pass are wanted: that pass takes blocks in their order up to
the one where the target is met. Those block quotas, one for each source and pass, form a vector that is split down a
binary tree over the output shards: at each node the left half draws its number of blocks without replacement, by a
multivariate hypergeometric law. A shard takes the blocks of a source that follow on those of the shards before it, so
that no two shards share one in a pass, and what a document adds to the mix is read off the tree. Sources beyond
TREE_KINDS are gathered into that many groups: the tree splits the groups' quotas, and what a group draws at a node is
split among its sources by the same law, which gives the law of the whole.

In the block where a target is met documents are taken in permuted order, and the one that crosses it gives only as
many words as are wanted. Within a shard the documents are ordered by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.common import WORD_PATTERN, fresh_names, settle_table, word_count

#: Documents of a block on average, and blocks of a source at most; a source's blocks are put in order by one task.
BLOCK_DOCS, SOURCE_BLOCKS = 2048, 65_536
#: Kinds of blocks that the driver splits; it sees one row for each.
TREE_KINDS = 4096
#: Sources whose targets are worked out as a list on the driver; more are worked out in rounds over a table.
LISTED = 10_000
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Share `budget` by weight; no source over `most` times its size, the excess going to the others."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), budget
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def table_targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """targets() for a table with `words` and `weight`: adds `target`. Each round caps sources or is the last."""
    unit = 0.0
    while True:
        over = F.lit(unit) * F.col("weight") > F.lit(most) * F.col("words")
        r = sources.agg(F.sum(F.when(over, F.col("words")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        after = (budget - most * r[0]) / r[1] if r[1] else unit
        if not after > unit:
            break
        unit = after
    return sources.withColumn("target", F.least(F.lit(unit) * F.col("weight"), F.lit(most) * F.col("words")))


def split_tree(quotas: list[int] | np.ndarray, totals: list[int] | np.ndarray, seed: int) -> np.ndarray:
    """Blocks of each kind for each shard (shards x kinds); rows add up to `totals`, columns to the quotas, exactly."""
    out = np.zeros((len(totals), len(quotas)), dtype=np.int64)
    rng = np.random.default_rng(seed)

    def halve(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid = (low + high) // 2
        drawn = int(sum(totals[low:mid]))
        left = rng.multivariate_hypergeometric(counts, drawn, method="marginals") if drawn else np.zeros_like(counts)
        halve(left, low, mid)
        halve(counts - left, mid, high)

    if len(quotas):
        halve(np.asarray(quotas, dtype=np.int64), 0, len(totals))
    return out


def fair(total: int, shards: int) -> list[int]:
    """`total` in `shards` parts that differ by one at most."""
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def _recipe(narrow: DataFrame, share: float, most: float, weights) -> DataFrame:
    """(source, words, target, passes, rest, blocks) of every source, as a settled table."""
    totals = settle_table(narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    many, words = totals.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    if many <= LISTED:
        named = sorted(totals.collect(), key=lambda r: (r["source"] == "n", r["source"]))
        sizes = [float(r["words"]) for r in named]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(named))], share * words, most)
        rows = [(r["source"], r["words"], r["docs"], float(t)) for r, t in zip(named, goal, strict=True)]
        out = totals.sparkSession.createDataFrame(rows, "source string, words long, docs long, target double")
    else:
        # A source's weight goes by its place: ranges of the sorted names, numbered within and offset by a table of ranges.
        order = [F.col("source") == "n", F.col("source")]
        ranged = settle_table(totals.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
        counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())  # one row for each partition
        base = np.cumsum([0, *[c for _, c in counts]])[:-1].tolist()
        bases = totals.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(counts, base, strict=True)], "range int, base long")
        place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("base")
        ranged = ranged.join(F.broadcast(bases), "range").withColumn("place", place)
        each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
        out = table_targets(settle_table(ranged.select("source", "words", "docs", each.alias("weight"))), share * words, most).drop("weight")
    passes = F.when(F.col("words") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("words") + 1e-12))).otherwise(0).cast("int")
    out = out.withColumn("passes", passes)
    rest = F.when(F.col("passes") < most, F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("words")).cast("long"))).otherwise(0)
    blocks = F.least(F.lit(SOURCE_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("int")
    return settle_table(out.select("source", "words", "target", "passes", rest.cast("long").alias("rest"), blocks.alias("blocks")))


def _tree(kinds: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, ends): for each pass of a source, where each shard's blocks end in the source's order.

    `kinds` has source, pass and quota.
    """
    spark = kinds.sparkSession
    n = kinds.count()
    groups = min(TREE_KINDS, max(1, n))
    kinds = kinds.withColumn("g", F.pmod(F.xxhash64("source", "pass", F.lit(seed)), F.lit(groups)).cast("int"))
    sums = sorted((r["g"], r["q"]) for r in kinds.groupBy("g").agg(F.sum("quota").alias("q")).collect())  # TREE_KINDS rows at most
    split = split_tree([q for _, q in sums], fair(sum(q for _, q in sums), shards), seed)
    drawn = spark.createDataFrame([(g, split[:, i].tolist()) for i, (g, _) in enumerate(sums)], "g int, drawn array<long>")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "pass"])
        own = split_tree(group["quota"].to_numpy(), list(group["drawn"].iloc[0]), seed + 1 + int(group["g"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "pass": group["pass"], "ends": np.cumsum(own, axis=0).T.tolist()})

    ends = kinds.join(F.broadcast(drawn), "g").groupBy("g").applyInPandas(within, "source string, pass int, ends array<long>")
    return ends.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pass", "ends"))).alias("tree"))


def _shard_of(tree: Column, place: Column) -> Column:
    """For each pass the shard that takes the block at `place` in its source's order, -1 where none does."""
    return F.transform(tree, lambda t: F.when(place < F.element_at(t["ends"], -1), F.size(F.filter(t["ends"], lambda e: e <= place))).otherwise(-1))


def plan(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, shards: int = 8,
    text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 11,
) -> DataFrame:
    """Add size, source_size, target, copies, taken, part and shard_of_copy (one shard for each copy) to every row.

    Size is the number of words; a null text has none and is taken with its block at no cost. Sources are ordered by
    code point with null last, which is a source like any other; weights repeat in that order. `taken` is the number of
    words that the mix takes of the row, whole passes and a part; a source's rows take its target, rounded to a word.
    `part` is the length in words of the last copy where it is not whole, else null. Rows repeated whole are separate
    documents: of many equal ones at the edge of a target some are taken and some not. Input columns with the names
    of result columns are replaced, all others are kept. An empty table, or one without words, gives targets of 0.
    """
    new = {"size", "source_size", "target", "copies", "taken", "part", "shard_of_copy"}
    own = [c for c in docs.columns if c.lower() not in new]
    *key, at, whole, words, n = fresh_names(docs, "s", "u1", "u2", "at", "whole", "words", "n")
    s, u1, u2 = key
    rows = docs.select(
        *[F.col(f"`{c}`") for c in own],
        word_count(F.col(f"`{text}`")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n")).alias(s),
        *[F.xxhash64(F.lit(seed + i), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias(u) for i, u in enumerate((u1, u2))],
    )
    narrow = settle_table(rows.select(F.col(s).alias("source"), F.col(u1).alias("u1"), F.col(u2).alias("u2"), "size"))
    recipe = _recipe(narrow, share, most, weights)
    block = F.pmod(F.xxhash64("u1", F.lit(seed + 1)), F.col("blocks")).cast("int").alias("block")
    # Equal documents are one row with their number from here on.
    each = narrow.groupBy("source", "u1", "u2").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    each = settle_table(each.join(recipe, "source").select("source", "u1", "u2", "size", "n", "rest", "passes", block))

    blocks = each.groupBy("source", "block", "rest", "passes").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    order = Window.partitionBy("source").orderBy("rank", "block")  # SOURCE_BLOCKS rows at most
    blocks = blocks.withColumn("rank", F.xxhash64("source", "block", F.lit(seed + 2)))
    blocks = blocks.withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("place", F.row_number().over(order) - 1)
    blocks = settle_table(blocks.withColumn("left", F.col("rest") - F.col("before")))
    quotas = blocks.groupBy("source").agg(F.count("*").alias("all"), F.max("passes").alias("p"), F.count_if(F.col("left") > 0).alias("x"))
    several = F.concat(F.array_repeat(F.col("all"), F.col("p")), F.array(F.col("x")))
    tree = settle_table(_tree(settle_table(quotas.select("source", F.posexplode(several).alias("pass", "quota"))), shards, seed))

    # What the pass that meets the target takes of a block: all of it, or documents in order up to `left` words.
    met = each.join(blocks.where("left > 0 and left < words").select("source", "block", "left"), ["source", "block"])
    along = Window.partitionBy("source").orderBy(F.xxhash64("u1", F.lit(seed + 3)), "u1", "u2")  # the documents of one block
    mass = F.col("size") * F.col("n")
    part = F.greatest(F.lit(0), F.least(F.col("left") - F.sum(mass).over(along) + mass, mass))
    met = met.select("source", "u1", "u2", "size", "n", part.alias("words"))
    # Of n equal documents words / size are taken whole, and one in part.
    full = F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size"))).otherwise(F.col("n"))
    met = met.select("source", "u1", "u2", full.alias("whole"), (F.col("words") - full * F.col("size")).alias("words"))

    places = blocks.select("source", "block", "place").join(tree, "source")
    places = settle_table(places.select("source", "block", _shard_of(F.col("tree"), F.col("place")).alias("at")))
    goals = recipe.select("source", F.col("words").alias("source_size"), "target")
    one = each.join(places, ["source", "block"]).join(settle_table(met), ["source", "u1", "u2"], "left").join(goals, "source")
    one = settle_table(
        one.select(
            F.col("source").alias(s), F.col("u1").alias(u1), F.col("u2").alias(u2), "source_size", "target", F.col("at").alias(at),
            F.coalesce("whole", "n").alias(whole), F.coalesce("words", F.lit(0)).alias(words), F.col("n").alias(n),
        )
    )

    def finished(rows: DataFrame, number: Column) -> DataFrame:
        """`number` counts equal documents from 0."""
        passes, last = F.size(at) - 1, F.element_at(at, -1)
        partly = (number == F.col(whole)) & (F.col(words) > 0)
        takes = (last >= 0) & ((number < F.col(whole)) | partly)
        given = F.when(~takes, 0).when(partly, F.col(words)).otherwise(F.col("size"))
        return rows.join(one, key).select(
            *[F.col(f"`{c}`") for c in own], "size", "source_size", "target",
            (passes + takes.cast("int")).alias("copies"), (F.col("size") * passes + given).alias("taken"), F.when(takes & partly, F.col(words)).alias("part"),
            F.when(takes, F.col(at)).otherwise(F.slice(F.col(at), F.lit(1), passes)).alias("shard_of_copy"),
        )

    split = settle_table(one.where((F.col(n) > 1) & (F.col(whole) < F.col(n))).select(*key))  # one for each source at most
    if split.isEmpty():
        return finished(rows, F.lit(0))
    # Equal documents of which a target takes some: numbered by the partition that they came from and within it.
    (number, pid) = fresh_names(rows, "number", "pid")
    equal = settle_table(rows.join(split, key, "left_semi").withColumn(pid, F.spark_partition_id()))
    counts = equal.groupBy(*key, pid).count()
    base = F.sum("count").over(Window.partitionBy(*key).orderBy(pid)) - F.col("count")
    base = settle_table(counts.select(*key, pid, base.alias(number)))
    within = F.row_number().over(Window.partitionBy(*key, pid).orderBy(F.lit(0))) - 1
    equal = equal.join(base, [*key, pid]).withColumn(number, F.col(number) + within)
    return finished(rows.join(split, key, "left_anti"), F.lit(0)).unionByName(finished(equal, F.col(number)))


def first_words(text: Column, many: Column) -> Column:
    """The beginning of a text up to and including its `many`-th word, as written."""
    space = WORD_PATTERN.replace("[^", "[")
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN.replace("+", "") + "+" + space.replace("+", "*")), F.lit(0)), F.lit(1), many)
    return F.concat(F.regexp_extract(text, "^" + space.replace("+", "*"), 0), F.regexp_replace(F.array_join(words, ""), space + "$", ""))


def mix(docs: DataFrame, length: str | None = None, **options) -> DataFrame:
    """The mixed rows: each document as often as it is taken, with mix_shard and its place mix_order in the shard's order.

    A copy that is taken in part has the text's first words, as written; `length` names a column that then gets its
    number of characters. Nulls, empty texts, repeated rows and clashing names as in plan(); a row that is not taken
    does not appear, and an empty table gives an empty result. Input columns named mix_shard or mix_order are replaced.
    """
    seed, text = options.get("seed", 11), options.get("text", "text")
    own = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    # plan() replaces columns with the names of its results; they go through it under others.
    aside = dict(zip(own, fresh_names(kept, *[f"own_{i}" for i in range(len(own))]), strict=True))
    named = {"text": "text", "source": "source", "doc_id": "doc_id"} | {k: v for k, v in options.items() if k in ("text", "source", "doc_id")}
    planned = plan(kept.withColumnsRenamed(aside), **(options | {k: aside[v] for k, v in named.items()}))
    out = planned.select(*aside.values(), "copies", "part", F.posexplode("shard_of_copy").alias("copy", "mix_shard"))
    out = out.withColumn("mix_order", F.xxhash64(F.col(aside[named["doc_id"]]), "copy", F.lit(seed + 4)))
    cut = F.col("part").isNotNull() & (F.col("copy") == F.col("copies") - 1)
    shown = {c: F.col(a) for c, a in aside.items()}
    shown[text] = F.when(cut, first_words(F.col(aside[text]), F.col("part").cast("int"))).otherwise(F.col(aside[text]))
    if length is not None:
        shown[length] = F.when(cut, F.length(shown[text]).cast("long")).otherwise(F.col(aside[length]))
    out = out.select(*[v.alias(c) for c, v in shown.items()], "mix_shard", "mix_order")
    return out.repartition("mix_shard", F.pmod("mix_order", F.lit(64))).sortWithinPartitions("mix_shard", "mix_order")
