"""SimHash near-duplicates, verified behind tables of distances to pivots.

A fingerprint's Hamming distances to PIVOTS reference fingerprints are computed once. Two fingerprints
that differ in at most RADIUS bits differ by at most RADIUS in every such distance, so a pair with a larger
difference in any coordinate is discarded; the others are verified bit by bit.

Distances to pivots cannot serve as a join key (an interval of distances is no equality), so the pairs to
look at are those that share one of four bands of 16 bits: at most three differing bits leave one band of
four intact. Buckets of over BUCKET fingerprints are divided by four bands of the remaining bits, and once
more if need be, by the same argument, so that no bucket is cut short; fingerprints that share a bucket then agree in 37
bits at least. A bucket yields a spanning forest
of its links rather than all pairs; components are then joined by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import fresh_names, settle, settle_table, worker_memory

BANDS, RADIUS, PIVOTS, BUCKET = 4, 3, 16, 2048
_REFERENCES = [int(x) for x in np.random.default_rng(64).integers(-(1 << 63), 1 << 63, PIVOTS)]
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, as a signed number: a bit is set if over half the shingles' hashes have it; no words give 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, size = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, size)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: size - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
    total = len(hashes)
    blocks = np.append(hashes, np.zeros(-total % 255, dtype=np.uint64)).reshape(-1, 255)
    out = 0
    for bit in range(8):  # eight one-byte counters in each 64-bit lane; 255 summands cannot overflow them
        lanes = ((blocks >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * int(counts[byte]) > total:
                out |= 1 << (8 * byte + bit)
    return out - (1 << 64) if out >> 63 else out


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the fingerprint of a text column as a long, in place of a column of that name.

    Null, empty and blank texts have 0; repeated rows have equal ones; an empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        worker_memory("simhash")
        return texts.map(fingerprint, na_action=None)

    return docs.withColumn(into, of(F.col(f"`{text}`")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Add `pivots`: the distances to the reference fingerprints, eight to a long."""
    words = []
    for first in range(0, PIVOTS, 8):
        word = F.lit(0).cast("long")
        for i, reference in enumerate(_REFERENCES[first : first + 8]):
            apart = F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference))).cast("long")
            word = word.bitwiseOR(F.shiftleft(apart, 8 * i))
        words.append(word)
    return fps.withColumn("pivots", F.array(*words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(mask_left: list[int]) -> list[int]:
    """Four masks that share out the given bit positions."""
    size = -(-len(mask_left) // BANDS)
    return [sum(1 << b for b in mask_left[i : i + size]) for i in range(0, len(mask_left), size)]


def _keyed(rows: DataFrame, used: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Rows of (fp, pivots, path) dealt to the bands that are left; used: the mask that each path has fixed."""
    paths, options = {}, []
    for path, mask in used.items():
        for i, band in enumerate(_bands([b for b in range(64) if not mask >> b & 1])):
            paths[path * 8 + i + 1] = mask | band
            fixed = F.col("fp").bitwiseAND(F.lit(_signed(mask | band)))
            options.append((path, F.struct(F.lit(path * 8 + i + 1).alias("path"), F.xxhash64(F.lit(path * 8 + i + 1), fixed).alias("key"))))
    chosen = None
    for path in used:
        several = F.array(*[o for p, o in options if p == path])
        chosen = F.when(F.col("path") == path, several) if chosen is None else chosen.when(F.col("path") == path, several)
    return rows.select("fp", "pivots", F.explode(chosen).alias("o")).select("fp", "pivots", "o.path", "o.key"), paths


def buckets(fps: DataFrame, largest: int = BUCKET) -> DataFrame:
    """(fp, pivots, key): every pair within RADIUS bits shares a key; overfull keys are divided again, twice at most."""
    rows, used = fps.withColumn("path", F.lit(0)), {0: 0}
    done = None
    for level in range(3):
        rows, used = _keyed(rows, used)
        if level < 2:
            full = settle(rows.groupBy("key").count().where(F.col("count") > largest).select("key"))
            kept = rows.join(full, "key", "left_anti").select("fp", "pivots", "key")
            rows = rows.join(full, "key", "left_semi").select("fp", "pivots", "path")
            done = kept if done is None else done.unionByName(kept)
            if full.isEmpty():
                return done
        else:
            done = done.unionByName(rows.select("fp", "pivots", "key"))
    return done


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: one link from each fingerprint to the smallest linked one of its bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        table, bits = pivots.view(np.uint8).reshape(len(fp), PIVOTS), fp.view(np.uint64)
        left, right = [], []
        at, step = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[key[at + step] == key[at]]
            near = at
            for c in range(PIVOTS):
                apart = table[near, c].astype(np.int16) - table[near + step, c]
                near = near[np.abs(apart) <= RADIUS]
            near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= RADIUS]
            left.append(near)
            right.append(near + step)
            step += 1
        if not left:
            return pa.RecordBatch.from_pydict({"a": [], "b": []}, schema=schema)
        root = forest(len(fp), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], schema=schema)

    rest = None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False)
        pivots = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fp), -1)
        if rest is not None:
            key, fp, pivots = (np.concatenate(x) for x in zip(rest, (key, fp, pivots), strict=True))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
        rest = (key[cut:], fp[cut:], np.ascontiguousarray(pivots[cut:]))
        if cut:
            yield work(key[:cut], fp[:cut], np.ascontiguousarray(pivots[:cut]))
    if rest is not None and len(rest[0]):
        yield work(*rest)


def links(fps: DataFrame, largest: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect whatever differs in RADIUS bits or fewer."""
    dealt = buckets(settle(pivot_table(fps)), largest).repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp", "pivots").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked component, for every node with a link but the root itself.

    Alternating star contractions: each node's larger neighbours are tied to its smallest one, then its
    smaller ones. A node with very many links is never gathered; its minimum is a partial aggregate. Every round
    that changes anything ties some node to a smaller one, so the rounds end.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Settled, so that Spark may divide a hub's edges in the join: its other side is then a bare shuffle too.
        low = settle_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def _classes(printed: DataFrame) -> DataFrame:
    """(fp, root, component_id) from (doc_id, fp); the root is the component's smallest fingerprint."""
    nodes = settle(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = settle_table(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    The component is named by the smallest doc_id among the rows reachable over links of at most RADIUS
    bits. Null, empty and blank texts have the fingerprint 0 and are linked like any other; rows with a
    null id belong to a component without naming it (null if no member has an id). Repeated rows each
    appear. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    printed = settle(with_fingerprint(rows).select("doc_id", "fp"))
    return printed.join(_classes(printed), "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest id (nulls last, then by the text's hash).

    Null, empty and blank texts are one component, with whatever is linked to them. Of rows repeated whole one stays.
    All columns are kept as they are, whatever their names; an empty table gives an empty result.
    """
    who, m1, m2 = fresh_names(docs, "who", "m1", "m2")
    marks = {m1: F.xxhash64(F.col(f"`{text}`")), m2: F.xxhash64(F.lit(1), F.col(f"`{text}`"))}
    keyed = docs.withColumns(marks).withColumn(who, F.xxhash64(F.col(f"`{doc_id}`")))
    row = [who, m1, m2]
    rows = keyed.select(F.col(who).alias("w"), F.col(m1).alias("m1"), F.col(m2).alias("m2"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    printed = settle(with_fingerprint(rows).select("w", "m1", "m2", "doc_id", "fp"))
    nodes = printed.join(_classes(printed), "fp")  # the root names a component even where no member has an id
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("m1").alias("m"), F.col("m2").alias("o"))
    chosen = nodes.groupBy("root").agg(F.min_by(F.struct("w", "m1", "m2"), order).alias("c")).select("c.*")
    chosen = settle(chosen)
    kept = keyed.join(chosen.toDF(*row), row, "left_semi")
    copies = printed.join(chosen, ["w", "m1", "m2"], "left_semi").groupBy("w", "m1", "m2").count().where("count > 1")
    if not copies.isEmpty():  # rows repeated whole: only then one of them must be picked
        kept = kept.dropDuplicates(row)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
