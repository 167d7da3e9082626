"""Byte-level BPE by DuckDB recursive queries inside each partition.

A text is cut at white space into segments, which the pre-tokenizer's pattern never joins; a segment met
for the first time is split by the pattern into words. In DuckDB, rows (word, position, token) start with
one byte each. A recursive query joins neighbouring rows with the merge table, finds each word's leftmost
pair of minimum rank, contracts it, and goes on until no word has a pair left. Segments are told apart by
their bytes within a batch, and by XXH3 digests of 128 bits in what each worker keeps of their ids, up to a
fixed number. Decoding makes a row for each token and its
position, joins the pieces and aggregates them in the order of positions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import by_bytes, fresh_names, worker_memory

#: White space as Unicode's property has it, spelled out because regular expression engines differ.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ASCII_SPACES = " \t\n\x0b\x0c\r"
#: Segments that a worker keeps, at some 40 bytes each; beyond it starts anew.
CACHED_SEGMENTS = 1_500_000
#: Bytes of text that are cut and looked up at once; a single longer document is handled whole.
CHUNK = 1 << 20
#: Words of more bytes contract all pairs that are the minimum of their surroundings in one step.
SHORT_WORD = 64
#: Bytes of words, and token rows over all steps, of one recursive query; ids that are decoded at once.
BATCH_BYTES, BATCH_ROWS, DECODE_IDS = 1 << 17, 1 << 22, 1 << 19
#: Documents that a worker returns at once, and bytes of their texts; a longer text comes alone.
ROWS, BATCH_TEXT = 500, 4 << 20


@dataclass
class Vocabulary:
    """Ranks as pieces in order, and the merge table: which two neighbours become which rank."""

    pieces: list[bytes]
    pair: np.ndarray
    rank: np.ndarray
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines 'base64 rank', read on the driver and shipped with the tasks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls.of(ranks, pattern)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        found = []
        for token, rank in ranks.items():
            pieces[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        pair, rank = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return cls(pieces, pair, rank, pattern)


#: One pair of each word at a time. state.pos counts from the word's first byte in the batch, without gaps.
_SHORT = """
WITH RECURSIVE state(word, pos, id, step) AS MATERIALIZED (
    SELECT word, pos, id, 0 FROM start
    UNION ALL
    (WITH best AS (
        SELECT s.word, min(m.rank * 4294967296 + s.pos) AS b
        FROM state s JOIN state n ON n.pos = s.pos + 1 JOIN merges m ON m.pair = s.id * 4294967296 + n.id
        GROUP BY s.word)
    SELECT s.word, CASE WHEN s.pos > (b & 4294967295) THEN s.pos - 1 ELSE s.pos END,
        CASE WHEN s.pos = (b & 4294967295) THEN b >> 32 ELSE s.id END, s.step + 1
    FROM state s JOIN best USING (word) WHERE s.pos <> (b & 4294967295) + 1)
), ended AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, list(id ORDER BY pos) AS ids FROM state JOIN ended USING (word, step) GROUP BY word ORDER BY word
"""

#: All pairs that are the leftmost minimum of their surroundings, `reach` bytes before and twice that behind, where no
#: token of the words is longer than `reach`. What is contracted farther away cannot come to touch such a pair before
#: its turn: the token would have to be longer. So the result is that of one pair after the other.
_LONG = """
WITH RECURSIVE state(word, pos, byte, id, step) AS MATERIALIZED (
    SELECT word, pos, byte, id, 0 FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT s.word, s.pos, s.byte, m.rank, m.rank * 4294967296 + s.pos AS b
        FROM state s JOIN state n ON n.pos = s.pos + 1 JOIN merges m ON m.pair = s.id * 4294967296 + n.id
        WHERE s.step < {most}),
    around AS (
        SELECT *, min(b) OVER (PARTITION BY word ORDER BY byte RANGE BETWEEN {reach} PRECEDING AND 2 * {reach} FOLLOWING) AS low FROM pairs),
    taken AS (SELECT pos, rank FROM around WHERE b = low),
    marked AS (
        SELECT s.word, s.pos, s.byte, coalesce(t.rank, s.id) AS id, s.step, u.pos IS NOT NULL AS gone
        FROM state s LEFT JOIN taken t ON t.pos = s.pos LEFT JOIN taken u ON u.pos + 1 = s.pos
        WHERE s.word IN (SELECT word FROM pairs)),
    moved AS (SELECT *, pos - sum(gone::INT) OVER (PARTITION BY word ORDER BY pos) AS at_pos FROM marked)
    SELECT word, at_pos::BIGINT, byte, id, step + 1 FROM moved WHERE NOT gone)
), ended AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, list(id ORDER BY pos) AS ids, any_value(step) AS step
FROM state JOIN ended USING (word, step) GROUP BY word ORDER BY word
"""

#: A row for each token and position, its piece from the merge table's spelling, put together in the order of positions.
_DECODE = """
SELECT row, string_agg(piece, '' ORDER BY pos) AS hex
FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM asked) JOIN spelling USING (id)
GROUP BY row ORDER BY row
"""


class Known:
    """Ids of segments by the two halves of a digest: the first halves sorted, and where a segment's ids lie in one flat array."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.check = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.many = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each of some digests, in ascending order of the first half, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[at] == hashes) & (self.check[at] == checks), at, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, lists: list[np.ndarray]) -> None:
        """New segments, in ascending order of the first half."""
        many = np.array([len(x) for x in lists], dtype=np.int32)
        total = int(many.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used // 2, 2 * total), dtype=np.uint32)])
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(lists)
        first = self.used + np.cumsum(many) - many
        self.used += total
        at = np.searchsorted(self.hash, hashes)
        for name, values in (("hash", hashes), ("check", checks), ("first", first), ("many", many)):
            setattr(self, name, np.insert(getattr(self, name), at, values))


class Codec:
    """A worker's encoder and decoder for one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = Known()
        self.odd = re.compile(f"[{''.join(c for c in SPACES if c not in ASCII_SPACES)}]")
        self.space = np.zeros(256, dtype=bool)
        self.space[[ord(c) for c in ASCII_SPACES]] = True
        self.segments = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        pattern = vocabulary.pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")
        self.words = regex.compile(pattern)
        self.lengths = np.array([len(piece) for piece in vocabulary.pieces], dtype=np.int64)
        #: Which bytes each piece has, as 256 bits.
        self.holds = np.array([self._bits(piece) for piece in vocabulary.pieces], dtype=np.uint64)
        self.bytes = np.zeros(256, dtype=np.int64)
        for rank, piece in enumerate(vocabulary.pieces):
            if len(piece) == 1:
                self.bytes[piece[0]] = rank
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._table("merges", {"pair": vocabulary.pair, "rank": vocabulary.rank})
        self._table("spelling", {"id": np.arange(len(vocabulary.pieces)), "piece": [p.hex() for p in vocabulary.pieces]})

    @staticmethod
    def _bits(data: bytes) -> list[int]:
        whole = sum(1 << b for b in set(data))
        return [whole >> 64 * i & (1 << 64) - 1 for i in range(4)]

    def _reach(self, words: list[bytes]) -> int:
        """Bytes of the longest token that is made of bytes of these words."""
        other = ~np.array(self._bits(b"".join(words)), dtype=np.uint64)
        return int(self.lengths[((self.holds & other) == 0).all(axis=1)].max(initial=1))

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, lists: list[np.ndarray]) -> None:
        """The table start: a row for each token; a gap in pos parts the words. byte is where the token begins."""
        sizes = np.array([len(x) for x in lists])
        word, ids = np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists)
        byte = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        self._table("start", {"word": word, "pos": np.arange(len(word)) + word, "byte": byte, "id": ids})

    def _query(self, sql: str) -> tuple[list[np.ndarray], np.ndarray | None]:
        found = self.db.sql(sql).to_arrow_table()
        column = found.column("ids").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        return np.split(flat, ends), found.column("step").to_numpy() if "step" in found.column_names else None

    def _short(self, words: list[bytes]) -> list[np.ndarray]:
        self._rows([self.bytes[np.frombuffer(w, dtype=np.uint8)] for w in words])
        return self._query(_SHORT)[0]

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        lists, open_words = [self.bytes[np.frombuffer(w, dtype=np.uint8)] for w in words], list(range(len(words)))
        reach = self._reach(words)
        while open_words:
            part = [lists[i] for i in open_words]
            self._rows(part)
            most = max(1, BATCH_ROWS // sum(map(len, part)))
            found, steps = self._query(_LONG.format(most=most, reach=reach))
            for i, ids in zip(open_words, found, strict=True):
                lists[i] = ids.astype(np.int64)
            open_words = [i for i, s in zip(open_words, steps, strict=True) if s >= most]
        return [x.astype("<u4") for x in lists]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for run, kind in ((self._short, [w for w in words if len(w) <= SHORT_WORD]), (self._long, [w for w in words if len(w) > SHORT_WORD])):
            group, size = [], 0
            for i, w in enumerate(kind):
                group.append(w)
                size += len(w)
                if size >= BATCH_BYTES or i == len(kind) - 1:
                    out.update(zip(group, (x.tobytes() for x in run(group)), strict=True))
                    group, size = [], 0
        return out

    def _ids(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of whole segments, by way of their distinct words."""
        split = [[w.encode() for w in self.words.findall(s)] for s in segments]
        known = self._encode_words(list(dict.fromkeys(w for words in split for w in words)))
        return [np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4") for words in split]

    def _cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(the texts together, where segments start, segments of each text), for texts with ASCII spaces only."""
        data = b"".join(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        blank = self.space[raw]
        begins = np.zeros(len(raw) + 1, dtype=bool)  # of texts
        begins[np.cumsum(sizes) - sizes] = True
        begins[-1] = True
        before, plain = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
        before[1:] = blank[:-1]
        plain[1:] = raw[:-1] == 32
        last = np.ones(len(raw), dtype=bool)  # a space with a word of the same text right behind it
        last[:-1] = blank[1:]
        last = blank & ~last & ~begins[1:]
        start = begins[:-1] | (blank & ~before) | last | (~blank & before & ~plain)
        at = np.flatnonzero(start)
        return data, at, np.diff(np.searchsorted(at, np.concatenate(([0], np.cumsum(sizes)))))

    def _chunk(self, texts: list[bytes]) -> list[bytes]:
        data, at, counts = self._cut(texts)
        if not len(at):
            return [b""] * len(texts)
        places = np.append(at, len(data)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        segments, back = cut.dictionary.to_pylist(), cut.indices.to_numpy()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, segments)), dtype=np.uint64).reshape(-1, 2)
        by = np.argsort(digests[:, 0], kind="stable")
        fresh, checks = digests[by, 0], digests[by, 1]
        place = self.known.find(fresh, checks)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if len(self.known.hash) + len(missing) > CACHED_SEGMENTS:
                self.known = Known()
                missing = np.arange(len(fresh))
            self.known.add(fresh[missing], checks[missing], self._ids([segments[i].decode() for i in by[missing]]))
            place = self.known.find(fresh, checks)
        of = np.empty(len(by), dtype=np.int64)
        of[by] = place
        place = of
        own = place[back]
        many = self.known.many[own].astype(np.int64)
        ends = np.cumsum(many)
        ids = self.known.ids[np.repeat(self.known.first[own] - ends + many, many) + np.arange(ends[-1])].astype("<u4")
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        rows, group, size = [], [], 0
        for i, text in enumerate(texts):
            if self.odd.search(text):  # other white space: rare enough for a plain way
                out[i] = b"".join(x.tobytes() for x in self._ids(self.segments.findall(text)))
                continue
            rows.append(i)
            group.append(text.encode())
            size += len(group[-1])
            if size >= CHUNK:
                for row, ids in zip(rows, self._chunk(group), strict=True):
                    out[row] = ids
                rows, group, size = [], [], 0
        if rows:
            for row, ids in zip(rows, self._chunk(group), strict=True):
                out[row] = ids
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that the ids stand for."""
        out: list[bytes] = []
        first = size = 0
        for i, item in enumerate(ids):
            size += len(item) // 4
            if size >= DECODE_IDS or i == len(ids) - 1:
                part = ids[first : i + 1]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in part]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(part), dtype="<u4"))
                self.db.register("asked", pa.table({"row": np.arange(len(part)), "ids": pa.ListArray.from_arrays(ends, flat)}))
                found = self.db.sql(_DECODE).to_arrow_table()
                texts = [b""] * len(part)
                for row, digits in zip(found.column("row").to_pylist(), found.column("hex").to_pylist(), strict=True):
                    texts[row] = bytes.fromhex(digits)
                out += texts
                self.db.unregister("asked")
                first, size = i + 1, 0
        return out


def _codec(key: str, shared) -> Codec:
    """The worker's codec; it outlives a task where Spark reuses the worker."""
    kept = worker_memory(f"bpe {key}")
    if "codec" not in kept:
        kept["codec"] = Codec(shared.value)
    return kept["codec"]


def _mapped(rows: DataFrame, column: str, work, vocabulary: Vocabulary, shown: str) -> DataFrame:
    """rows with `column` put through work(codec, values); the result's fields follow the other columns."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary: a few MB
    key = f"{len(vocabulary.pieces)}-{vocabulary.pieces[-1].hex()}-{hash(vocabulary.pattern)}-{shared._jbroadcast.id() if shared._jbroadcast else 0}"
    own = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_bytes(batches, -1, BATCH_TEXT):
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                made = work(_codec(key, shared), batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.values()], names=[*own, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in own]).schema.fields]
    ordered = rows.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{column}`").alias(fresh_names(rows, "value")[0]))
    return ordered.mapInArrow(run, ", ".join([*fields, shown]))


def _encode(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
    ids = codec.encode([t or "" for t in texts])
    return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}


def _both(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
    ids = codec.encode([t or "" for t in texts])
    tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
    return {"n_tokens": tokens, "ids": pa.array(ids, pa.binary()), "decoded": pa.array(codec.decode(ids), pa.binary())}


def _decode(codec: Codec, ids: list[bytes | None]) -> dict[str, pa.Array]:
    return {"decoded": pa.array(codec.decode([x or b"" for x in ids]), pa.binary())}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", decoded: bool = False) -> DataFrame:
    """The rows with n_tokens and ids (little-endian unsigned 32-bit integers) in place of the text.

    With `decoded` the bytes that decode() makes of the ids come along, from the same worker. Null and empty
    texts have no ids. Special tokens in a text are ordinary text. Input columns with the names of result
    columns are replaced. Repeated rows are encoded alike; an empty table gives an empty result.
    """
    made = {"n_tokens", "ids", *(["decoded"] if decoded else [])}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in made and c != text])
    if decoded:
        return _mapped(rows, text, _both, vocabulary, "n_tokens long, ids binary, decoded binary")
    return _mapped(rows, text, _encode, vocabulary, "n_tokens long, ids binary")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows with the decoded bytes in place of the ids; null and empty ids give no bytes.

    An input column named decoded is replaced. Repeated rows are decoded alike; an empty table gives an empty result.
    """
    return _mapped(rows.drop(*[c for c in rows.columns if c.lower() == "decoded" and c != ids]), ids, _decode, vocabulary, "decoded binary")


def id_list(ids: str = "ids") -> F.Column:
    """The packed ids as an array of integers."""

    @F.pandas_udf("array<int>")
    def of(values):
        return values.map(lambda x: np.frombuffer(x, dtype="<u4").astype(np.int32) if x else np.zeros(0, np.int32), na_action=None)

    return of(F.col(f"`{ids}`"))
