"""Periodic runs of words, found by uniting suffix classes in descending order of their common prefixes.

A run is a stretch of words with a smallest period q that no neighbouring word extends. The suffixes of a text are put
into an order in which those with a common prefix stand together; neighbours of that order are linked by the length of
their common prefix (LCP). Links are taken in descending order of LCP, as Kruskal takes edges: a union-find keeps the
classes, each with its positions in ascending order. When classes are united at LCP l, two positions i < j of different
classes may become neighbours in the united set. Both begin the same l words, so the words from i up to j + l have the
period j - i; where j - i <= l it is the smallest one, since a smaller one would have put a position of the same class
between them. A position before which the period breaks thus begins a run of length l + j - i, and every run with twice
its period or more is met once: at its first position, with the one a period later.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import by_bytes, fresh_names, worker_memory

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4
#: Bytes of text that are searched together; a longer text comes alone.
CHUNK = 1 << 20
#: A set takes so many new positions one by one; more are sorted in.
FEW = 40


def least_prefix(least: int, times: int) -> int:
    """The smallest LCP at which a run may begin: a run of length n and period q has an LCP of n - q."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 2) + 1))


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, positions ahead of them) of neighbours in the order of suffixes that share their first `depth` numbers.

    By prefix doubling, of the suffixes alone that still have equals. The last number of x and every number that ends a
    text stand there once, so no prefix that two suffixes share goes beyond. `depth` is a power of two.
    """
    n = len(x)
    by = np.argsort(x, kind="stable")
    slots = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = x[by][1:] != x[by][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[by] = np.maximum.accumulate(np.where(new, slots, 0))
    order, group, h = by, rank[by], 1
    deep = None
    while True:
        alone = new & np.append(new[1:], True)
        if h == depth:  # each group of this order has its own slots from here on
            order, group, slots = order[~alone], group[~alone], slots[~alone]
            deep, first = slots, group
            if not len(deep):
                return deep, deep
            final = np.zeros(n, dtype=np.int64)
            final[slots] = order
        else:
            order, group, slots = order[~alone], group[~alone], slots[~alone]
        if not len(order):
            if deep is None:
                return order, order
            break
        key = group * n + rank[order + h]
        place = np.argsort(key, kind="stable")  # groups are in ascending order already, so slots stay as they are
        order, key = order[place], key[place]
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = slots[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        rank[order] = group
        if deep is not None:
            final[slots] = order
        h *= 2
    linked = np.flatnonzero(first[1:] == first[:-1]) + 1
    return final[deep[linked]], final[deep[linked] - 1]


def common_prefixes(x: list[int], position: list[int], ahead: list[int], depth: int) -> list[int]:
    """The LCP of each position, in ascending order, with the one ahead of it; from one to the next it falls by one at most."""
    out, last, shared = [], -2, depth
    for i, j in zip(position, ahead, strict=True):
        shared = max(shared - 1, depth) if i == last + 1 else depth
        while x[i + shared] == x[j + shared]:
            shared += 1
        out.append(shared)
        last = i
    return out


def united(sets: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """One ordered set of several, and the pairs of different sets that are neighbours in it."""
    sets.sort(key=len)
    large = sets.pop()
    small = sorted((v, k) for k, one in enumerate(sets) for v in one)
    fresh, last = [], len(small) - 1
    for t, (v, k) in enumerate(small):
        at = bisect_left(large, v)
        if t and (not at or small[t - 1][0] > large[at - 1]):
            if small[t - 1][1] != k:
                fresh.append((small[t - 1][0], v))
        elif at:
            fresh.append((large[at - 1], v))
        if at < len(large) and (t == last or small[t + 1][0] > large[at]):
            fresh.append((v, large[at]))
    if len(small) < FEW:
        for v, _ in small:
            insort(large, v)
    else:
        large += [v for v, _ in small]
        large.sort()
    return large, fresh


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least, times * period), by start and period.

    x holds numbers of words, and a number of its own behind each text.
    """
    if times < 2:
        raise ValueError("a run holds its period twice or more")
    prefix = least_prefix(least, times)
    depth = 1 << (max(prefix, 1).bit_length() - 1)
    position, ahead = suffix_order(x, depth)
    by = np.argsort(position, kind="stable")
    position, ahead = position[by], ahead[by]
    if not len(position):
        return []
    word = x.tolist()
    shared = np.array(common_prefixes(word, position.tolist(), ahead.tolist(), depth))
    by = np.flatnonzero(shared >= prefix)
    by = by[np.argsort(-shared[by], kind="stable")]
    level, one, other = shared[by].tolist(), position[by].tolist(), ahead[by].tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(i: int) -> int:
        if i not in parent:
            parent[i] = i
            members[i] = [i]
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found, at = [], 0
    while at < len(level):
        l, touched = level[at], {}
        while at < len(level) and level[at] == l:  # all links of one LCP unite their classes together
            a, b = root(one[at]), root(other[at])
            if len(members[a]) < len(members[b]):
                a, b = b, a
            parent[b] = a
            touched[a] = [*touched.get(a, [members[a]]), *touched.pop(b, [members[b]])]
            at += 1
        for a, sets in touched.items():
            for gone in sets:
                members.pop(gone[0], None)
            members[a], fresh = united(sets)
            for i, j in fresh:
                if l + j - i >= max(least, times * (j - i)) and word[i - 1] != word[j - 1]:
                    found.append((i, l + j - i, j - i))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def _numbers(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words by their bytes, with one of its own behind each text; where texts begin)."""
    flat = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    x = np.empty(int(begin[-1]), dtype=np.int64)
    ends = begin[1:] - 1
    inside = np.ones(len(x), dtype=bool)
    inside[ends] = False
    x[inside] = flat.indices.to_numpy(zero_copy_only=False)
    x[ends] = len(flat.dictionary) + np.arange(len(ends))
    return x, begin


def search(texts: list[str | None], least: int = LEAST, times: int = TIMES) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """(number of words, runs, collapsed text) of each text; null counts as empty.

    Collapsed is a text whose runs are left with their first period: a word goes if any run holds it behind that. Its
    other words are joined by one space.
    """
    words = [(t or "").encode().split() for t in texts]
    x, begin = _numbers(words)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(x, least, times):
        doc = int(np.searchsorted(begin, start, side="right")) - 1
        runs[doc].append((start - int(begin[doc]), length, period))
    collapsed = []
    for own, found in zip(words, runs, strict=True):
        if found:
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            for start, length, period in found:
                edge[start + period] += 1
                edge[start + length] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        collapsed.append(b" ".join(own).decode())
    return [len(w) for w in words], runs, collapsed


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with n_words, runs (start, length and period in words, by start and period) and collapsed in place of the text.

    Runs have `least` words and `times` periods or more. Null, empty and blank texts have no words, no runs and '' as
    collapsed text. Repeated rows are searched alike. A text is searched whole by one task, in memory that grows with
    the text alone; texts are searched some CHUNK bytes at a time. Input columns with the names of result columns are
    replaced, all others stay, whatever their names. An empty table gives an empty result.
    """
    made = ("n_words", "runs", "collapsed")
    own = [c for c in docs.columns if c.lower() not in made and c != text]
    (body,) = fresh_names(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias(body))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("periodic")
        for batch in by_bytes(batches, -1, CHUNK):
            many, runs, left = search(batch.column(batch.num_columns - 1).to_pylist(), least, times)
            flat = np.array([r for one in runs for r in one], dtype=np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(kind))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
            columns = [pa.array(many, pa.int64()), pa.ListArray.from_arrays(ends, spans), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*own, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    shown = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, ", ".join([*fields, shown]))
