"""Approximate nearest neighbours by largest inner product: IVF-PQ with exact reranking.

Equal vectors are indexed once, with the smallest ids that carry them. A bounded sample gives coarse centroids and the
codebooks of the residuals' parts; every vector is put into the list of its nearest centroid and kept as codes. Beyond
MAX_LISTS lists each is divided by a second level of centroids, fitted on the residuals and shared by all lists, so
that lists grow in number with the square root of the rows at any size. A query visits the lists whose centroids have
the largest product with it; their number is set on some of the queries, whose true neighbours among all rows are found
by brute force, so that these lists hold PROBED of them.

Codes are scored by an asymmetric distance table (query part times codeword). Every vector keeps the length of what its
code leaves out; the share of it that products with queries reach, measured on the sample, bounds the error of its
score. All vectors whose score may reach the k-th best within these bounds, however many, are scored again on the
original vectors in double precision: among near copies, which share their codes, none is left to chance.

Lists are cut into blocks and dealt to shards. A query goes to the shards of its lists; codes and vectors go to their
shard once; only where a shard is asked by more than QUERIES queries are these cut into chunks, each with a copy of the
shard. A shard scores its vectors again itself and returns the k + 1 best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.common import settle_table, unit_hash

#: Vectors that centroids and codebooks are fitted on at most; every vector is indexed.
SAMPLE = 16_384
#: Fine parts of two numbers make few candidates enough.
MAX_LISTS, PART, CODES, ROUNDS = 2048, 2, 256, 8
#: Pairs scored again at a time, and the best by score of the sample that bound the error of a code, for each query.
PAIRS, BOUNDED = 1 << 18, 256
#: Largest component of a vector at the index's scale, where the sample's median length is about 1.
LARGEST = 1e9
#: Vectors of a shard on average, and the smaller number that shards are cut to for as long as cores are idle; queries of a chunk.
BLOCK, SMALL, QUERIES = 65_536, 4_096, 16_384
#: Share of the true neighbours that the visited lists are to hold, and queries that set their number.
PROBED, TUNED = 0.97, 256


@dataclass
class Index:
    """Centroids of the first and second level (levels x dims), codebooks (parts x codes x dims of a part), lists that a query visits.

    Vectors are taken times `scale`, queries at length 1. `share` is the part of a residual's length that products reach.

    The list of the centroids i and j is numbered i * len(finer) + j; its centre is their sum.
    """

    centroids: np.ndarray
    finer: np.ndarray
    books: np.ndarray
    probes: int = 1
    scale: float = 1.0
    share: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x.astype(np.float64) * self.scale, -LARGEST, LARGEST).astype(np.float32)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of the nearest centroid, by distance, at both levels."""
        first = _nearest(x, self.centroids)
        return first * len(self.finer) + _nearest(x - self.centroids[first], self.finer)

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists // len(self.finer)] + self.finer[lists % len(self.finer)]

    def visited(self, q: np.ndarray) -> np.ndarray:
        """(queries x probes) the lists that each query visits.

        The best p sums of one value from each level have their parts among the p best of that level.
        """
        one, two = q @ self.centroids.T, q @ self.finer.T
        a = np.argsort(-one, axis=1, kind="stable")[:, : self.probes]
        b = np.argsort(-two, axis=1, kind="stable")[:, : self.probes]
        near = np.take_along_axis(one, a, 1)[:, :, None] + np.take_along_axis(two, b, 1)[:, None, :]
        near = near.reshape(len(q), -1)
        lists = (a[:, :, None] * len(self.finer) + b[:, None, :]).reshape(len(q), -1)
        best = np.argsort(-near, axis=1, kind="stable")[:, : self.probes]
        return np.take_along_axis(lists, best, 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = _padded(x - self.centres(lists), self.books.shape[2])
        parts = rest.reshape(len(x), len(self.books), -1)
        return np.stack([_nearest(parts[:, i], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far the product of each vector with a query may lie from that of its code, rounding included."""
        known = self.decode(lists, codes)
        wide = x.astype(np.float64) * self.scale
        length = np.linalg.norm(wide, axis=1) + np.linalg.norm(known, axis=1) + np.linalg.norm(self.centres(lists), axis=1)
        return self.share * np.linalg.norm(wide - known, axis=1) + 4e-6 * length

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        centres = self.centres(lists).astype(np.float64)
        parts = np.stack([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return centres + parts.reshape(len(codes), -1)[:, : centres.shape[1]]

    def places(self, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For one query, how many lists come before each of `own`."""
        one, two = self.centroids @ q, self.finer @ q
        score = one[own // len(two)] + two[own % len(two)]
        better = len(two) - np.searchsorted(np.sort(two), score[:, None] - one[None, :] + 1e-6)
        return better.sum(axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries x parts x codes) products of query parts and codewords."""
        parts = _padded(q, self.books.shape[2]).reshape(len(q), len(self.books), -1)
        return np.einsum("qpd,pcd->qpc", parts, self.books, optimize=True)


def _padded(x: np.ndarray, part: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % part)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from a random start; empty centres move to random points."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def unit_rows(q: np.ndarray) -> np.ndarray:
    """Queries at length 1, which leaves the order of their products as it is."""
    wide = q.astype(np.float64)
    wide /= np.maximum(np.abs(wide).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return (wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def fit(sample: np.ndarray, lists: int, queries: np.ndarray, finer: int = 1, seed: int = 13) -> Index:
    """An index of lists * finer lists, with the error of its codes measured on the sample's vectors nearest to the queries."""
    rng = np.random.default_rng(seed)
    length = float(np.median(np.linalg.norm(sample.astype(np.float64), axis=1)))
    scale, raw = 2.0 ** -round(np.log2(length)), sample
    index = Index(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros((1, 1, 1)), scale=scale)
    sample = index.scaled(sample)
    index.centroids = _means(sample, lists, rng)
    rest = sample - index.centroids[_nearest(sample, index.centroids)]
    index.finer = _means(rest, finer, rng) if finer > 1 else np.zeros((1, sample.shape[1]), dtype=np.float32)
    rest = _padded(rest - index.finer[_nearest(rest, index.finer)], PART)
    parts = rest.reshape(len(sample), -1, PART)
    index.books = np.stack([_means(parts[:, i], CODES, rng) for i in range(parts.shape[1])])
    own, wide, q = index.lists(sample), raw.astype(np.float64) * scale, unit_rows(queries).astype(np.float64)
    rest = wide - index.decode(own, index.encode(sample, own))
    long, most = np.linalg.norm(rest, axis=1), min(BOUNDED, len(sample))
    shares = [0.0]
    for one in q:
        near = np.argpartition(-(wide @ one), most - 1)[:most]
        near = near[long[near] > 1e-6 * np.linalg.norm(wide[near], axis=1)]
        shares.append(float((np.abs(rest[near] @ one) / long[near]).max(initial=0.0)))
    index.share = min(1.0, max(1.1 * max(shares), 4 / sample.shape[1] ** 0.5))
    return index


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _truth(queries: np.ndarray, own: np.ndarray, k: int):
    """The k nearest nodes of each query within a partition, by brute force; `own` are the queries' nodes."""
    wide = queries.astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, node = np.full((len(wide), 0), -np.inf), np.zeros((len(wide), 0), np.int64)
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.iloc[low : low + 4096]
                ids = part["node"].to_numpy()
                near = wide @ np.stack(part["vector"].to_numpy()).astype(np.float64).T
                near[own[:, None] == ids[None, :]] = -np.inf
                score, node = np.hstack([score, near]), np.hstack([node, np.broadcast_to(ids, near.shape)])
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, node = np.take_along_axis(score, best, 1), np.take_along_axis(node, best, 1)
        of = np.repeat(np.arange(len(wide)), score.shape[1])
        found = pd.DataFrame({"of": of, "node": node.ravel(), "score": score.ravel()})
        yield found[found["score"] > -np.inf]

    return run


def _scorer(index: Index, most: int):
    """The best `most` of a shard for each query of a chunk, among the lists that it visits.

    Codes decide which vectors may be among them; these are scored in double precision, summed in the order of the
    components.
    """

    def exact(q: np.ndarray, x: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        score = np.zeros(len(of))
        for one, other in zip(q, x, strict=True):
            score += one[of] * other[at]
        return score

    def run(key, codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asked):
            return pd.DataFrame({"asker": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        codes = codes.sort_values("list", kind="stable")
        table = np.frombuffer(b"".join(codes["code"]), dtype=np.uint8).reshape(len(codes), -1)
        lists, first = np.unique(codes["list"].to_numpy(), return_index=True)
        ends, nodes, out = np.append(first[1:], len(codes)), codes["node"].to_numpy(), []
        wide, error = np.stack(codes["vector"].to_numpy()).T.astype(np.float64), codes["error"].to_numpy().astype(np.float32)
        centres = index.centres(lists)
        step = max(1, (1 << 22) // len(codes))
        for low in range(0, len(asked), step):
            part = asked.iloc[low : low + step]
            raw = np.stack(part["vector"].to_numpy())
            q = unit_rows(raw)
            # Queries come last, so that looking a code up copies a row of all their values.
            tables, base, wanted = np.ascontiguousarray(index.tables(q).transpose(1, 2, 0)), centres @ q.T, index.visited(q)
            at = np.minimum(np.searchsorted(lists, wanted), len(lists) - 1)
            visits = np.zeros((len(q), len(lists)), dtype=bool)
            rows, columns = np.nonzero(lists[at] == wanted)
            visits[rows, at[rows, columns]] = True
            near = np.full((len(codes), len(q)), -np.inf, dtype=np.float32)
            for one, (start, end) in enumerate(zip(first, ends, strict=True)):
                rows = np.flatnonzero(visits[:, one])
                if len(rows):
                    every = 2 * len(rows) > len(q)
                    own, some = (tables, base[one]) if every else (tables[:, :, rows], base[one, rows])
                    some = np.repeat(some[None].astype(np.float32), end - start, axis=0)
                    for i in range(table.shape[1]):
                        some += own[i].take(table[start:end, i], axis=0)
                    near[start:end, rows] = some[:, rows] if every else some
            near = np.ascontiguousarray(near.T)
            k = min(most, len(codes))
            floor = -np.partition(error - near, k - 1, axis=1)[:, k - 1 : k]
            of, at = np.nonzero((near + error >= floor) & (near > -np.inf))
            del near
            columns = raw.T.astype(np.float64)
            score = np.concatenate([exact(columns, wide, of[i : i + PAIRS], at[i : i + PAIRS]) for i in range(0, len(of), PAIRS)] or [np.zeros(0)])
            order = np.lexsort((nodes[at], -score, of))
            of, at, score = of[order], at[order], score[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            out.append(pd.DataFrame({"asker": part["asker"].to_numpy()[of[best]], "node": nodes[at[best]], "score": score[best]}))
        return pd.concat(out)

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `is_query` holds.

    Candidates are all rows but the query's own; ties go to the smaller id, which is exact for equal
    vectors however many there are. Rows with a null id, or a vector that is null, zero, of another length
    than the commonest, or with null or non-finite components take no part. Rows repeated whole are one
    row. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    spark = vectors.sparkSession
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == lengths["n"])
    rows = rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    key = ["k1", "k2"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    few = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    nodes = few.groupBy(*key).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.any_value("vector").alias("vector"))
    asked = rows.where("q").select("id", *key)
    nodes = nodes.join(asked.select(*key).distinct().withColumn("asks", F.lit(True)), key, "left")
    nodes = settle_table(nodes.select(*key, F.col("ids")[0].alias("node"), "ids", "vector", F.coalesce("asks", F.lit(False)).alias("asks")))
    total = nodes.count()

    near = unit_hash("k1", seed=17)  # those of the smallest hashes, the same in every run
    drawn = nodes.where(near < F.lit(min(1.0, 2 * SAMPLE / max(total, 1) + 0.01))).orderBy(near, *key).limit(SAMPLE).select("vector").collect()
    sample = np.array([r["vector"] for r in drawn or nodes.select("vector").limit(1).collect()], dtype=np.float32)
    tuned = nodes.where("asks").orderBy(near, *key).limit(TUNED).select("node", "vector").collect()
    own, queries = np.array([r["node"] for r in tuned], dtype=np.int64), np.array([r["vector"] for r in tuned], dtype=np.float32).reshape(-1, sample.shape[1])
    wanted = 2 ** round(np.log2(max(1.0, total**0.5)))
    coarse = min(MAX_LISTS, wanted, len(sample))
    index = fit(sample, coarse, queries, min(-(-wanted // coarse), MAX_LISTS, len(sample)))

    @F.pandas_udf("struct<list:long,code:binary,error:double>")
    def coded(x: pd.Series) -> pd.DataFrame:
        values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, index.centroids.shape[1]), np.float32)
        scaled = index.scaled(values)
        lists = index.lists(scaled)
        codes = index.encode(scaled, lists)
        return pd.DataFrame({"list": lists, "code": [c.tobytes() for c in codes], "error": index.errors(values, lists, codes)})

    table = settle_table(nodes.select("node", "vector", coded("vector").alias("c")).select("node", "vector", "c.list", "c.code", "c.error"))
    best = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "node"))
    true = table.select("node", "vector").mapInPandas(_truth(queries, own, k), "of long, node long, score double")
    true = true.withColumn("n", best).where(F.col("n") <= k).select("of", "node")
    homes_of = true.join(table.select("node", "list"), "node").groupBy("of").agg(F.collect_list("list").alias("lists")).collect()
    units = unit_rows(queries)
    places = [p for r in homes_of for p in index.places(units[r["of"]], np.array(r["lists"])).tolist()]
    every = len(index.centroids) * len(index.finer)
    index.probes = min(every, int(np.quantile(places, PROBED)) + 3) if places else every
    sizes = table.groupBy("list").count().collect()  # about the square root of the rows
    blocks = {r["list"]: -(-r["count"] // BLOCK) for r in sizes}
    shards = max(-(-total // BLOCK), min(spark.sparkContext.defaultParallelism, -(-total // SMALL)))
    homes = {one: sorted({(one * 7919 + b * 104729) % shards for b in range(n)}) for one, n in blocks.items()}

    @F.pandas_udf("array<int>")
    def route(x: pd.Series) -> pd.Series:
        q = unit_rows(np.stack(x.to_numpy())) if len(x) else np.zeros((0, index.centroids.shape[1]), np.float32)
        return pd.Series([sorted({s for one in v for s in homes.get(one, ())}) for v in index.visited(q).tolist()], index=x.index)

    cut = spark.createDataFrame(sorted(blocks.items()), "list long, blocks int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    table = table.join(F.broadcast(cut), "list").withColumn("shard", ((F.col("list") * 7919 + block * 104729) % shards).cast("int"))
    asking = nodes.where("asks").select(F.col("node").alias("asker"), "vector")
    routed = settle_table(asking.withColumn("shards", route("vector")))
    visits = routed.select("asker", "vector", F.explode("shards").alias("shard"))
    asked_by = visits.groupBy("shard").count().select("shard", F.ceil(F.col("count") / QUERIES).cast("int").alias("chunks"))
    asked_by = F.broadcast(settle_table(asked_by))  # one row for each shard of some BLOCK vectors
    visits = visits.join(asked_by, "shard").withColumn("chunk", F.pmod(F.xxhash64("asker"), F.col("chunks")).cast("int")).drop("chunks")
    copies = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    table = table.join(asked_by, "shard").select("shard", copies, "list", "node", "code", "error", "vector")
    found = (
        table.groupBy("shard", "chunk")
        .cogroup(visits.groupBy("shard", "chunk"))
        .applyInPandas(_scorer(index, k + 1), "asker long, node long, score double")
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "node")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    exact = found.join(nodes.select("node", "ids"), "node")
    members = exact.select("asker", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    members = members.withColumn("n", best).where(F.col("n") <= k + 1)
    near = members.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    near = settle_table(near.join(nodes.where("asks").select(F.col("node").alias("asker"), *key), "asker"))

    # A query row meets its vector's list, leaves itself out and keeps the first k.
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("id")), 1, k)
    out = asked.distinct().join(near, key).select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))
