"""Substring deduplication by relative Lempel-Ziv parsing against blocks of the corpus itself.

The reference is the whole corpus. Every text is cut into reference blocks: the stretch of consecutive windows of
WINDOW words that share their anchor, the group of ANCHOR words with the smallest hash in the window. Equal windows
have equal anchors wherever they stand, so a window recurs in blocks indexed under its anchor or nowhere, and one
narrow row for each block is all that is shuffled to find them. A text is then factored from left to right:

- a block whose anchor occurs once in the corpus has no reference block: its words are literals;
- a block that equals another one, by a digest of 128 bits, is copied whole into the factor;
- any other block goes with its words to the group of its anchor's different blocks. There it is parsed greedily: at
  the first window that stands in another block, the match is extended word by word to its end, the factor is closed,
  and the window that crosses the factor's end is looked up next, so that no match across a boundary is missed. Words
  are compared as they are written, not by hashes. Anchors with over GROUP different blocks have their blocks cut
  into blocks of one window, which are equal or not by their digests, so that no group must be gathered;
- factors whose windows follow each other are one: across blocks they are put together in the order of the text.

Factors have WINDOW words at least, and their words are removed. Texts are known by a hash of 128 bits, blocks by
another: among 1e13 blocks the chance that any two different ones share it is some 1e-13.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import WordHasher, by_bytes, fresh_names, settle_table, worker_memory

WINDOW, ANCHOR = 35, 14
#: Bytes of text that are hashed at once; a single longer document is hashed whole.
CHUNK = 1 << 21
#: Different blocks of one anchor that are parsed against each other in one task, some 400 bytes each.
GROUP = 512
_POSITION = np.uint64((1 << 24) - 1)
_LONGEST = 1 << 23


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words_of(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of the texts together."""
    start, _, hashes = hasher.words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, side="right")


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    reach, out = 1, values
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def blocks_of(hasher: WordHasher, hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int):
    """(document, first window, windows, anchor hash) of each block; windows are word positions."""
    if len(hashes) < window:
        return None
    sums = hasher.sums(hashes)
    grams = np.arange(len(hashes) - anchor + 1)
    gram = hasher.runs(sums, grams, grams + anchor)
    packed = (gram & ~_POSITION) | grams.astype(np.uint64)
    place = (_minima(packed, window - anchor + 1) & _POSITION).astype(np.int64)
    at = np.arange(len(place))
    valid = doc[at] == doc[at + window - 1]
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(place))
    keep = valid[first]
    if not keep.any():
        return None
    first, last = first[keep], last[keep]
    return doc[first], first, last - first, gram[place[first]]


def digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each stretch of bytes."""
    digest = xxhash.xxh3_128_digest
    both = b"".join([digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(both, dtype=np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _segments(hashes: np.ndarray, doc: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches short enough for packed positions; they overlap so that each window lies in exactly one."""
    for low in range(0, max(1, len(hashes) - window + 1), _LONGEST):
        high = low + _LONGEST + window - 1
        yield low, hashes[low:high], doc[low:high]


def _blocks(window: int, anchor: int):
    """One row for each different block of each different text of a batch: where it stands there, and how often in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("substring")
        hasher = WordHasher()
        names = ["t1", "t2", "anchor", "b1", "b2", "firsts", "windows", "n"]
        for batch in by_bytes(batches, 2, CHUNK):
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, at, copies = np.unique(np.stack([t1, t2], axis=1), axis=0, return_index=True, return_counts=True)
            t1, t2 = t1[at], t2[at]
            texts = [b" ".join((t or "").encode().split()) for t in batch.column(2).take(pa.array(at)).to_pylist()]
            for low, high in chunks(texts):
                data = b"\n".join(texts[low:high])
                begin, end, hashes = hasher.words(data)
                doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[low:high]]), begin, side="right")
                counts = np.bincount(doc, minlength=high - low)
                base = np.cumsum(counts) - counts
                for offset, part, of in _segments(hashes, doc, window):
                    found = blocks_of(hasher, part, of, window, anchor)
                    if found is None:
                        continue
                    d, first, n, key = found
                    first = first + offset
                    b1, b2 = digests(data, begin[first], end[first + n + window - 2])
                    d, first = d + low, first - base[d]
                    by = np.lexsort((first, b2, b1, key, d))
                    same = [(x[by][1:] == x[by][:-1]) for x in (d, key, b1, b2)]
                    edge = np.concatenate(([0], np.flatnonzero(~np.logical_and.reduce(same)) + 1, [len(by)]))
                    one = by[edge[:-1]]
                    firsts = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(first[by].astype(np.int32)))
                    columns = [t1[d[one]], t2[d[one]], key[one].view(np.int64), b1[one], b2[one], firsts, n[one].astype(np.int32), copies[d[one]] * np.diff(edge)]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return run


def _spans(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """(where each row's spans begin and the last end, and the fields of all spans); rows of null have none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(sizes))), *[flat.field(n).to_numpy(zero_copy_only=False) for n in fields]


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each row's factors begin and the last end, first window, windows) of lists of (firsts, windows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    lists = flat.field("firsts")
    many = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(sizes)))]
    return ends, lists.flatten().to_numpy(zero_copy_only=False), np.repeat(flat.field("windows").to_numpy(zero_copy_only=False), many)


def _lookups(window: int):
    """The words of the blocks that must be parsed, or the digests of their windows where the anchor is overfull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("substring")
        names = ["t1", "t2", "k1", "k2", "first", "n", "body"]
        before = None
        for batch in by_bytes(batches, 2, CHUNK):
            edge, first, windows, anchor, copies, overfull = _spans(batch.column(3), "first", "windows", "anchor", "n", "overfull")
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            texts = batch.column(2).to_pylist()
            rows, k1, k2, at, n, body = [], [], [], [], [], []
            for row, text in enumerate(texts):
                if keys[row] == before:  # copies of a text come one after another; one of them tells all
                    continue
                before = keys[row]
                words = (text or "").encode().split()
                for i in range(edge[row], edge[row + 1]):
                    many = 1 if overfull[i] else int(windows[i])
                    for low in range(int(first[i]), int(first[i] + windows[i]), many):
                        piece = b" ".join(words[low : low + many + window - 1])
                        half = np.frombuffer(xxhash.xxh3_128_digest(piece), dtype=np.int64) if overfull[i] else (anchor[i], 0)
                        rows.append(row)
                        k1.append(int(half[0]))
                        k2.append(int(half[1]))
                        at.append(low)
                        n.append(int(copies[i]))
                        body.append(None if overfull[i] else piece)
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(body, pa.binary())],
                names=names,
            )

    return run


def factors(blocks: list[bytes], asks: list[bool], window: int) -> list[tuple[int, int, int]]:
    """(block, first word, words) of the factors of the asking blocks against all the others, greedily from the left.

    Blocks are words joined by one space. A factor starts at the first window that stands in another block and goes
    on for as long as the words agree with that block; what comes next is the window that crosses its end.
    """
    words = [b.split(b" ") for b in blocks]
    index: dict[bytes, list[tuple[int, int]]] = {}  # two places in different blocks are enough for every asker
    starts = []
    for block, (body, own) in enumerate(zip(blocks, words, strict=True)):
        ends = np.cumsum([len(w) + 1 for w in own]).tolist()
        begins = [0, *ends[:-1]]
        starts.append([body[a : b - 1] for a, b in zip(begins, ends[window - 1 :], strict=False)])
        for at, key in enumerate(starts[-1]):
            known = index.setdefault(key, [])
            if len(known) < 2 and (not known or known[0][0] != block):
                known.append((block, at))
    out = []
    for block, own in enumerate(words):
        at = 0
        while asks[block] and at < len(starts[block]):
            other = next(((b, i) for b, i in index[starts[block][at]] if b != block), None)
            if other is None:
                at += 1
                continue
            theirs, size = words[other[0]][other[1] :], window
            while at + size < len(own) and size < len(theirs) and own[at + size] == theirs[size]:
                size += 1
            out.append((block, at, size))
            at += size - window + 1
    return out


def _parse_groups(window: int):
    """Factors of the asking blocks of each anchor, from rows sorted by anchor."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        low = 0
        for high in range(1, len(rows) + 1):
            if high == len(rows) or rows[high][0] != rows[low][0]:
                # A text whose copies lie in several tasks has told of its blocks once in each.
                group = list({r[1:4]: r for r in rows[low:high]}.values())
                for i, at, size in factors([r[5] for r in group], [r[4] == 1 for r in group], window):
                    found.append((group[i][1], group[i][2], group[i][3] + at, size - window + 1))
                low = high
        kinds = (("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()))
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("substring")
        rest: list[tuple] = []
        for batch in batches:
            rest += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            cut = len(rest)
            while cut and rest[cut - 1][0] == rest[-1][0]:  # the last group may go on in the next batch
                cut -= 1
            if cut:
                yield work(rest[:cut])
                rest = rest[cut:]
        if rest:
            yield work(rest)

    return run


_WORD = re.compile(rb"[^ \t\n\r\f\v]+")


def cut_spans(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words, all other words and the white space between them as written.

    Of the white space before and behind a run of removed words the one with more line breaks stays, else the
    first; at either end of the text the outer one stays.
    """
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out, low = [], 0
    for first, last in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True):
        begin, end = at[first][0], at[last][1]
        before = text[at[first - 1][1] if first else 0 : begin]
        behind = text[end : at[last + 1][0] if last + 1 < len(at) else len(text)]
        if last + 1 == len(at) and first or first and behind.count(b"\n") > before.count(b"\n"):
            begin -= len(before)
        else:
            end += len(behind)
        out.append(text[low:begin])
        low = end
    return b"".join([*out, text[low:]])


def joined(first: np.ndarray, windows: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges of a text's factors, put together from left to right wherever the next one's windows follow on."""
    out: list[tuple[int, int]] = []
    upto = -1
    for i in np.argsort(first, kind="stable").tolist():
        low, high = int(first[i]), int(first[i] + windows[i])
        if low <= upto:
            upto = max(upto, high)
            out[-1] = (out[-1][0], upto + window - 1)
        else:
            upto = high
            out.append((low, high + window - 1))
    return out


def _cut(window: int, as_written: bool):
    """Cut a document's factors out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, -2, CHUNK):
            kept, total, removed = [], [], []
            edge, first, windows = _places(batch.column(batch.num_columns - 1))
            for row, text in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                body = (text or "").encode()
                words = body.split()
                total.append(len(words))
                gone = np.zeros(len(words), dtype=bool)
                own = slice(edge[row], edge[row + 1])
                for low, high in joined(first[own], windows[own], window):
                    gone[low:high] = True
                removed.append(int(gone.sum()))
                if removed[-1] and as_written:
                    text = cut_spans(body, gone).decode()
                elif removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(text if as_written else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                names=[*batch.schema.names[:-2], "kept", "n_words", "n_removed"],
            )

    return run


def text_key(text: F.Column) -> list[F.Column]:
    """128 bits that stand for a text, as two longs."""
    return [F.xxhash64(F.lit(seed), text) for seed in (101, 202)]


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(t1, t2, spans): the factors of every text with any, spans being an array of (firsts, windows).

    `texts` has the columns t1, t2 (text_key()) and body, one row for each document.
    """
    schema = "t1 long, t2 long, anchor long, b1 long, b2 long, firsts array<int>, windows int, n long"
    blocks = settle_table(texts.select("t1", "t2", "body").mapInArrow(_blocks(window, min(ANCHOR, window)), schema))
    # Tables are settled before they are joined, so that both sides of a join are bare shuffles and Spark can divide
    # the partition of an anchor that stands in very many texts.
    extremes = [f(c).alias(f"{f.__name__}_{c}") for c in ("b1", "b2") for f in (F.min, F.max)]
    known = blocks.groupBy("anchor").agg(F.sum("n").alias("all"), *extremes).where("all > 1")
    known = settle_table(known.select("anchor", F.expr("min_b1 = max_b1 and min_b2 = max_b2").alias("whole")))
    found = settle_table(blocks.join(known, "anchor"))

    place = F.struct("t1", "t2", F.col("firsts")[0].alias("first"), "windows")
    kinds = found.where("not whole").groupBy("anchor", "b1", "b2").agg(F.sum("n").alias("all"), F.min(place).alias("one"))
    kinds = settle_table(kinds)
    many = settle_table(kinds.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor", F.lit(True).alias("overfull")))
    asked = kinds.join(many, "anchor", "left")
    span = F.struct("one.first", "one.windows", "anchor", F.col("all").alias("n"), F.coalesce("overfull", F.lit(False)).alias("overfull"))
    asked = settle_table(asked.groupBy("one.t1", "one.t2").agg(F.collect_list(span).alias("asked")))
    asked = texts.join(asked, ["t1", "t2"]).select("t1", "t2", "body", "asked")
    rows = settle_table(asked.mapInArrow(_lookups(window), "t1 long, t2 long, k1 long, k2 long, first int, n long, body binary"))
    groups = rows.where("body is not null").repartition("k1").sortWithinPartitions("k1")
    parsed = groups.select("k1", "t1", "t2", "first", "n", "body").mapInArrow(_parse_groups(window), "t1 long, t2 long, first int, windows int")

    single = settle_table(rows.where("body is null").dropDuplicates(["k1", "k2", "t1", "t2", "first"]).drop("body"))
    again = settle_table(single.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1").select("k1", "k2"))
    crossed = single.join(again, ["k1", "k2"]).select("t1", "t2", F.array("first").alias("firsts"), F.lit(1).alias("windows"))
    parsed = parsed.select("t1", "t2", F.array("first").alias("firsts"), "windows")

    # Blocks with an equal one are copied whole, in every text that has them.
    equal = settle_table(kinds.where(F.col("all") > 1).select("anchor", "b1", "b2"))
    copied = found.where("not whole").join(equal, ["anchor", "b1", "b2"]).select("t1", "t2", "firsts", "windows")
    every = found.where("whole").select("t1", "t2", "firsts", "windows").unionByName(copied).unionByName(parsed).unionByName(crossed)
    # A text's factors: as many as it has windows at most, and again for each task that saw a copy of it.
    return settle_table(every.groupBy("t1", "t2").agg(F.collect_set(F.struct("firsts", "windows")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", as_written: bool = False) -> DataFrame:
    """Add kept (the remaining words, joined by one space; with `as_written` the text without its removed spans), n_words and n_removed to every row.

    A word goes if it lies in a window of `window` consecutive words whose sequence starts anywhere else
    too, in the same document or another, the first occurrence included. Null, empty and short texts lose
    nothing (kept is the text with its white space made even, '' for null; with `as_written` the text itself). Equal
    texts count as often as they stand in rows, repeated rows and rows without an id included, and lose the same words.
    Input columns with the names of result columns are replaced, the text column itself is not returned, and all
    others are kept whatever their names. An empty table gives an empty result.
    """
    new = {"kept", "n_words", "n_removed", text.lower()}
    own = [c for c in docs.columns if c.lower() not in new]
    t1, t2, body, spans = fresh_names(docs, "t1", "t2", "body", "spans")
    keys = [key.alias(name) for key, name in zip(text_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))), (t1, t2), strict=True)]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *keys, F.col(f"`{text}`").alias(body))
    found = repeated_spans(rows.select(t1, t2, body).toDF("t1", "t2", "body"), window)
    found = found.withColumnsRenamed({"t1": t1, "t2": t2, "spans": spans})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in own]
    out = ", ".join([*fields, "kept string, n_words long, n_removed long"])
    cut = rows.join(found, [t1, t2], "left").select(*[F.col(f"`{c}`") for c in own], body, spans)
    return cut.mapInArrow(_cut(window, as_written), out)
