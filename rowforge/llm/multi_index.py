"""Near-duplicate vectors by an inverted multi-index: links of a cosine or more between vectors of one label.

Each half of a vector has a codebook of its own, fitted on a bounded sample; the grid of both is the index, and a vector
lies in the cell of its nearest codewords. A vector's traversal takes the codewords of each half in ascending order of
how near their cells can come, and visits the cells of the grid, nearest first, until the target recall is met. A half
of any vector in another codeword's cell lies beyond the plane midway between that codeword and the own one, so the two
distances to such planes bound the distance from below: at a target of 1 the traversal ends where the bound passes the
distance of the threshold, and no link is lost. What is visited is verified in double precision.

Equal vectors of a label are one class, found by 128-bit digests. The cells of a label, in order, are cut into shards of
about SHARD classes, so that a cell of very many lies in several. A class goes to the shards that hold cells it visits,
once each; a label's askers are dealt into chunks. A shard returns how many vectors each class is linked with, and for
each linked class one tie to its group, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.common import settle_table, unit_hash, worker_memory
from rowforge.llm.simhash import components, forest

#: Vectors that the codebooks are fitted on at most; every vector is indexed.
SAMPLE, ROUNDS, MOST_CODES = 16_384, 8, 256
#: Classes of a shard on average, cells that a shard is to have, and askers of a chunk on average.
SHARD, CELLS, ASKERS = 4096, 8, 8192
#: Askers that are compared at once.
ROWS = 1024
#: What rounding may add to or take from a distance.
SLACK = 1e-7
#: Partners that are drawn to find how far a traversal goes for a recall below 1.
TUNED = 2048


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length in double precision at length 1."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = (book**2).sum(axis=1) / 2
    return (x @ book.T - half).argmax(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from points drawn at random; a codeword without points moves to one."""
    book = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, book)
        many = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        book = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], x[rng.integers(0, len(x), len(book))])
    return book


@dataclass
class MultiIndex:
    """Codebooks of both halves; the cell of codewords i and j is numbered i * len(second) + j. reach ends a traversal."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return _nearest(a, self.first) * len(self.second) + _nearest(b, self.second)

    @staticmethod
    def bounds(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """(rows x codewords) how far a half lies from each codeword's cell at least: its distance to the plane between."""
        apart = (book**2).sum(axis=1) - 2 * x @ book.T  # squared distances but for the row's own square
        own = (x @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
        between = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(axis=2), 0))[own]
        over = apart - apart[np.arange(len(x)), own][:, None]
        return np.maximum(np.divide(over, 2 * between, out=np.zeros_like(over), where=between > 0), 0)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: the multi-sequence traversal of each row up to reach, for all rows at once.

        Both sequences ascend; for the i-th codeword of the first half the traversal has got so far in the second as
        the sum of both squared bounds allows.
        """
        a, b = (self.bounds(half, book) ** 2 for half, book in zip(self.halves(x), (self.first, self.second), strict=True))
        by_a, by_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        rows, cells = [], []
        for i in range(a.shape[1]):
            got = a[:, i, None] + b <= (self.reach + SLACK) ** 2
            if not got[:, 0].any():
                break
            r, j = np.nonzero(got)
            rows.append(r)
            cells.append(by_a[r, i] * len(self.second) + by_b[r, j])
        r, c = np.concatenate(rows), np.concatenate(cells)
        by = np.argsort(r, kind="stable")
        return r[by], c[by]


def fit(sample: np.ndarray, codes: int, cosine: float, recall: float = 1.0, seed: int = 12) -> MultiIndex:
    """Codebooks of at most `codes` codewords from unit vectors, with the reach of the target recall.

    At 1 the reach is the distance of the threshold. Below it is the bound that this share of partners at the threshold
    in random directions from the sample do not pass; such partners are the hardest to find.
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    index = MultiIndex(_codebook(sample[:, :half], codes, rng), _codebook(sample[:, half:], codes, rng), math.sqrt(max(2 - 2 * cosine, 0)))
    if recall < 1:
        x = sample[rng.integers(0, len(sample), TUNED)]
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        partners = cosine * x + math.sqrt(max(1 - cosine**2, 0)) * aside
        cell = index.cells(partners)
        far = [index.bounds(h, book) for h, book in zip(index.halves(x), (index.first, index.second), strict=True)]
        rows = np.arange(len(x))
        apart = far[0][rows, cell // len(index.second)] ** 2 + far[1][rows, cell % len(index.second)] ** 2
        index.reach = min(index.reach, float(np.sqrt(np.quantile(apart, recall))))
    return index


def _packed(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, str]:
    """((vec_id, label, dims, digest, raw), numpy kind): vectors that take no part have a null digest."""
    wide = "double" in df.schema[vector].dataType.simpleString()
    kind = "<f8" if wide else "<f4"
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast(f"array<{'double' if wide else 'float'}>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("multi-index")
        for batch in batches:
            dims, digests, raws = [], [], []
            for v in batch.column(2):
                x = np.array(v.values, dtype=kind) + 0.0 if v.is_valid and not v.values.null_count else np.zeros(0, kind)  # -0.0 becomes 0.0
                usable = bool(np.isfinite(x).all()) and bool(x.any())
                raw = x.astype(kind).tobytes() if usable else None
                dims.append(len(x))
                raws.append(raw)
                digests.append(xxhash.xxh3_128_digest(raw) if usable else None)
            columns = [pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "label", "dims", "digest", "raw"])

    return rows.mapInArrow(run, f"vec_id long, label {df.schema[label].dataType.simpleString()}, dims int, digest binary, raw binary"), kind


def _placed(index: MultiIndex | None, kind: str):
    """Adds to each class its cell and the cells that it visits from there on; without an index for its length, cell 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, visits = np.zeros(len(batch), dtype=np.int32), [np.zeros(1, dtype=np.int32)] * len(batch)
            if index is not None:
                wide = index.first.shape[1] + index.second.shape[1]
                for low in range(0, len(batch), ROWS):
                    rows = low + np.flatnonzero(batch["dims"].iloc[low : low + ROWS].to_numpy() == wide)
                    if not len(rows):
                        continue
                    x = unit_rows(batch["raw"].iloc[rows].tolist(), kind)
                    cell[rows] = index.cells(x)
                    r, c = index.visits(x)
                    on = c > cell[rows][r]  # a pair is compared from the lower cell, within one cell from both
                    many = np.bincount(r[on], minlength=len(rows))
                    for i, part in zip(rows, np.split(c[on], np.cumsum(many)[:-1]), strict=True):
                        visits[i] = np.concatenate(([cell[i]], part)).astype(np.int32)
            yield batch.assign(cell=cell, visits=visits)

    return run


def _verify(kind: str, cosine: float):
    """One shard's classes and a chunk of its askers: (node, root, links) of every class that is linked here."""

    def run(home: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if not len(home) or not len(asks):
            return empty
        home, asks = home.sort_values("cell", kind="stable"), asks.rename(columns=lambda c: c.removeprefix("asker_"))
        x, y = unit_rows(asks["raw"].tolist(), kind), unit_rows(home["raw"].tolist(), kind)
        nodes, place = np.unique(np.concatenate([asks["cid"], home["cid"]]), return_inverse=True)
        at_x, at_y = place[: len(x)], place[len(x) :]
        many_x, many_y = asks["many"].to_numpy(np.int64), home["many"].to_numpy(np.int64)
        own, cells = asks["cell"].to_numpy(), home["cell"].to_numpy()
        visited = np.concatenate(asks["visits"].tolist())
        asker = np.repeat(np.arange(len(x)), [len(v) for v in asks["visits"]])
        by = np.argsort(visited, kind="stable")
        visited, asker = visited[by], asker[by]
        links, root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
        for cell in np.unique(cells):
            low, high = np.searchsorted(cells, [cell, cell + 1])
            mine = asker[slice(*np.searchsorted(visited, [cell, cell + 1]))]
            for first in range(0, len(mine), ROWS):
                rows = mine[first : first + ROWS]
                near = x[rows] @ y[low:high].T >= cosine
                near &= ~((own[rows] == cell)[:, None] & (at_x[rows][:, None] >= at_y[None, low:high]))
                if not near.any():
                    continue
                np.add.at(links, at_x[rows], near @ many_y[low:high])
                np.add.at(links, at_y[low:high], many_x[rows] @ near)
                i, j = np.nonzero(near)
                a, b = np.minimum(root[at_x[rows][i]], root[at_y[low:high][j]]), np.maximum(root[at_x[rows][i]], root[at_y[low:high][j]])
                pairs = np.unique(a * len(nodes) + b)
                root = forest(len(nodes), pairs // len(nodes), pairs % len(nodes))[root]
        linked = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[linked], "root": nodes[root[linked]], "links": links[linked]})

    return run


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, recall: float = 1.0, seed: int = 12
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of one label at `cosine` or more are linked.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, are linked with
    nothing; so are vectors of different lengths with each other. Each row counts as a vector, so equal rows are linked.
    A component is named by its smallest vec_id; rows with a null id belong to one without naming it, and have a null
    component_id where no member has an id. kept says that vec_id and component_id are the same, both null included.
    With recall = 1 every link is found, else about that share of the hardest. Other columns are ignored; an empty table
    gives an empty result.
    """
    packed, kind = _packed(df, vec_id, vector, label)
    usable = packed.where("digest is not null and label is not null")
    most, rows = usable.groupBy("label", "dims").count().agg(F.max("count"), F.sum("count")).first()
    index = None
    if rows:
        near = unit_hash("digest", seed=seed)
        sample = usable.where(near < F.lit(min(1.0, 2 * SAMPLE / rows))).groupBy("digest").agg(F.any_value("raw").alias("raw"))
        drawn = [r["raw"] for r in sample.orderBy(near, "digest").limit(SAMPLE).collect()]
        sizes, many = np.unique([len(r) for r in drawn], return_counts=True)
        if len(sizes) and sizes[many.argmax()] >= 2 * np.dtype(kind).itemsize:
            codes = min(MOST_CODES, max(2, math.ceil(math.sqrt(CELLS * most / SHARD))))
            index = fit(unit_rows([r for r in drawn if len(r) == sizes[many.argmax()]], kind), codes, cosine, recall, seed)

    classes = usable.groupBy("label", "dims", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.any_value("raw").alias("raw"))
    shape = f"label {packed.schema['label'].dataType.simpleString()}, dims int, digest binary, least long, many long, raw binary, cell int, visits array<int>"
    units = settle_table(classes.mapInPandas(_placed(index, kind), shape).withColumn("cid", F.monotonically_increasing_id()))

    group = ["label", "dims"]
    ahead = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = units.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumns({"low": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*group))})
    cells = settle_table(cells.withColumn("chunks", F.ceil(F.col("total") / ASKERS)).drop("total"))

    within = F.col("low") + F.floor(unit_hash("digest", seed=seed + 1) * F.col("n"))
    home = units.join(cells, [*group, "cell"]).withColumn("shard", F.floor(within / SHARD))
    home = home.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    home = home.select(*group, "shard", "chunk", "cid", "many", "raw", "cell")
    shards = F.explode(F.sequence(F.floor(F.col("low") / SHARD), F.floor((F.col("low") + F.col("n") - 1) / SHARD)))
    asked = units.select(*group, "cid", F.explode("visits").alias("cell")).join(cells, [*group, "cell"])
    asked = asked.select("cid", "chunks", shards.alias("shard")).distinct()
    asks = asked.join(units, "cid").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    asks = asks.select(*group, "shard", "chunk", "cid", "many", "raw", "cell", "visits")
    asks = asks.toDF(*[f"asker_{c}" for c in asks.columns])
    key = [*group, "shard", "chunk"]
    both = home.groupBy(*key).cogroup(asks.groupBy(*[f"asker_{c}" for c in key]))
    found = settle_table(both.applyInPandas(_verify(kind, cosine), "node long, root long, links long"))

    links = found.groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    named = units.drop("raw", "visits").join(roots, "cid", "left").join(links, "cid", "left")
    named = settle_table(named.select(*group, "digest", "least", F.coalesce("root", "cid").alias("root"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = settle_table(named.groupBy("root").agg(F.min("least").alias("component_id")))
    result = settle_table(named.join(least, "root").select(*group, "digest", "n_links", "component_id"))

    rows = packed.select("vec_id", *group, "digest")
    taking = F.col("digest").isNotNull() & F.col("label").isNotNull()
    linked = rows.where(taking).join(result, [*group, "digest"]).select("vec_id", "n_links", "component_id")
    free = rows.where(~taking).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(free).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
