"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowforge.session import settle, shared_folder

__all__ = ["settle", "shared_folder"]

#: A word is a run of anything but the space and the five ASCII controls 9 to 13; bytes.split() cuts at the same six.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_MASK = (1 << 64) - 1


def settle_table(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, a fraction of a checkpoint's size.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose values in a string column have about `size` bytes; a longer value comes alone."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)[:-1])) // size if len(lengths) else lengths
        edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(lengths) else []
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            yield batch.slice(low, high - low)


_KEPT: dict = {}


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps from task to task, for one operator at a time.

    Spark reuses workers; whatever another operator left is given back to the system first.
    """
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; absent elsewhere
        if trim is not None:
            trim(0)
    return _KEPT


def first_texts(rows: DataFrame, keys: list[str], text: str, most_rows: int, most_bytes: int) -> list[Row]:
    """The rows of (*keys, text) that come first by the keys, `most_rows` at most, as many as have `most_bytes` together (one at least).

    Keys are not null and tell texts apart, by a hash of them. Lengths are looked at first, so that neither repeated rows
    nor long texts bring more than that to the driver, and texts of any length are drawn alike: the draw is over when the
    next one does not fit.
    """
    sizes = rows.select(*keys, F.octet_length(text).alias("size")).orderBy(*keys).limit(most_rows).collect()
    drawn = sizes[: max(1, int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), most_bytes, side="right")))]
    if not drawn:
        return []
    named = rows.select(*keys).schema
    chosen = rows.sparkSession.createDataFrame([tuple(r)[:-1] for r in drawn], named).distinct()  # no more than most_rows
    bodies = rows.join(F.broadcast(chosen), keys).groupBy(*keys).agg(F.first(text).alias(text)).collect()
    body = {tuple(r)[:-1]: r for r in bodies}
    return [body[tuple(r)[:-1]] for r in drawn]


def unit_hash(*columns: Column | str, seed: int) -> Column:
    """A repeatable uniform draw in [0, 1) from the columns' values."""
    bits = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1))
    return bits.cast("double") / F.lit(float(1 << 52))


def word_count(text: Column | str) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of each word of all texts, text that it stands in, different words); equal numbers mean equal bytes."""
    words = [t.split() for t in texts]
    flat = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.repeat(np.arange(len(words)), [len(w) for w in words]), len(flat.dictionary)


class WordHasher:
    """64-bit hashes of the words of a byte string, and of runs of consecutive words, by prefix sums.

    A byte b at position i counts T[b] * B**i modulo 2**64 with B odd, so that the hash of any
    stretch is a difference of two prefix sums times a power of B's inverse.
    """

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(self.base, -1, 1 << 64)
            for name, factor in (("up", self.base), ("down", inverse)):
                powers = np.full(size, factor, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word; positions in bytes."""
        raw = np.frombuffer(data, dtype=np.uint8)
        blank = self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        return start, end, self.stretches(data, start, end)

    def stretches(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start up to end, for arrays of positions."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        self._reach(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * self.down[start]
        return mix64(hashes + (end - start).astype(np.uint64))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums over word hashes, for runs()."""
        self._reach(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start up to end, for arrays of positions."""
        return mix64((sums[end] - sums[start]) * self.down[start])
