"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte becomes a learned vector, with one more channel that says whether the four bytes from here
stood a few bytes before too (a repeated word). Learned filters run over every position of the document;
it is cut into chunks of CHUNK positions which overlap by the filters' width less one, so that the whole
document is covered. Each filter is max-pooled in each chunk, a dense layer makes a chunk's features, and
their mean and maximum over the chunks give one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import first_texts, unit_hash, worker_memory

CHUNK, WIDTH, CHANNELS, FILTERS, HIDDEN = 256, 5, 8, 16, 16
LAGS = range(2, 17)
GAP = max(WIDTH, LAGS.stop + 4)
#: Labelled rows that train the network at most, and bytes of all their texts, which bounds what the driver gathers.
TRAINING_ROWS, TRAINING_BYTES = 3000, 1 << 26
#: Steps of training at least, where there are few rows.
STEPS = 300
PAD = 256
#: Bytes that are run through the filters at once.
SLICE = 1 << 15
#: Bytes of texts that are laid out together; a longer document is laid out alone.
GROUP = 1 << 18
THRESHOLD = 0.3


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document of each chunk): every text padded to whole chunks.

    Padding before and behind a text is wider than filters and lags reach, so that a text's score does not
    depend on the texts beside it.
    """
    sizes = [-(-(len(t) + 2 * GAP) // CHUNK) for t in texts]
    starts = np.concatenate(([0], np.cumsum(sizes))) * CHUNK
    symbols = np.full(int(starts[-1]), PAD, dtype=np.int16)
    for text, at in zip(texts, starts, strict=False):
        symbols[at + GAP : at + GAP + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return symbols, np.repeat(np.arange(len(texts)), sizes)


def repeats(symbols: np.ndarray) -> np.ndarray:
    """1 where four bytes equal those some LAGS before."""
    own = symbols.astype(np.uint8)
    four = np.zeros(len(own), dtype=np.uint32)
    for i in range(4):
        four[: len(own) - i] |= own[i:].astype(np.uint32) << np.uint32(8 * i)
    hit = np.zeros(len(own), dtype=bool)
    for lag in LAGS:
        hit[lag:] |= four[lag:] == four[:-lag]
    return hit & (symbols != PAD)


class Network:
    """Parameters and passes; all arrays are float32."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.bytes = draw(PAD + 1, CHANNELS - 1, scale=0.5)
        self.bytes[PAD] = 0
        self.filters = draw(WIDTH * CHANNELS, FILTERS, scale=(WIDTH * CHANNELS) ** -0.5)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.dense = draw(FILTERS, HIDDEN, scale=FILTERS**-0.5)
        self.dense_bias = np.zeros(HIDDEN, dtype=np.float32)
        self.out = draw(2 * HIDDEN, scale=0.2)
        self.out_bias = np.zeros(1, dtype=np.float32)

    NAMES = ("bytes", "filters", "bias", "dense", "dense_bias", "out", "out_bias")

    def inputs(self, symbols: np.ndarray) -> np.ndarray:
        x = np.empty((len(symbols) + WIDTH - 1, CHANNELS), dtype=np.float32)
        x[: len(symbols), :-1] = self.bytes[symbols]
        x[: len(symbols), -1] = repeats(symbols)
        x[len(symbols) :] = 0
        return x

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(chunks x FILTERS) maxima, and where they stand if asked for."""
        n = len(x) - WIDTH + 1
        maxima = np.empty((n // CHUNK, FILTERS), dtype=np.float32)
        where = np.empty((n // CHUNK, FILTERS), dtype=np.int64) if places else None
        for low in range(0, n, SLICE):
            high = min(n, low + SLICE)
            view = np.lib.stride_tricks.as_strided(x[low:], (high - low, WIDTH * CHANNELS), (x.strides[0], x.strides[1]))
            out = (np.ascontiguousarray(view) @ self.filters).reshape(-1, CHUNK, FILTERS)
            rows = slice(low // CHUNK, high // CHUNK)
            if places:
                at = out.argmax(axis=1)
                where[rows] = at + low + np.arange(len(out))[:, None] * CHUNK
                maxima[rows] = np.take_along_axis(out, at[:, None], 1)[:, 0]
            else:
                maxima[rows] = out.max(axis=1)
        return maxima + self.bias, where

    def combine(self, maxima: np.ndarray, doc: np.ndarray, docs: int):
        """Probability of each document, and what backward() needs."""
        active = np.maximum(maxima, 0)
        hidden = np.maximum(active @ self.dense + self.dense_bias, 0)
        edge = np.searchsorted(doc, np.arange(docs))
        counts = np.bincount(doc, minlength=docs)[:, None].astype(np.float32)
        mean = np.add.reduceat(hidden, edge, axis=0) / counts
        top = np.maximum.reduceat(hidden, edge, axis=0)
        both = np.concatenate([mean, top], axis=1)
        logit = both @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (active, hidden, counts, top, both)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Scores of the texts; they are run in groups of about GROUP bytes, whole."""
        scores, group, size = np.zeros(len(texts)), [], 0
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text) + CHUNK
            if size >= GROUP or i == len(texts) - 1:
                symbols, doc = layout([texts[k] for k in group])
                maxima, _ = self.pooled(self.inputs(symbols))
                scores[group] = self.combine(maxima, doc, len(group))[0]
                group, size = [], 0
        return scores

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        symbols, doc = layout(texts)
        x = self.inputs(symbols)
        maxima, where = self.pooled(x, places=True)
        p, (active, hidden, counts, top, both) = self.combine(maxima, doc, len(texts))
        wrong = ((p - labels) / len(texts)).astype(np.float32)
        to_both = wrong[:, None] * self.out
        to_hidden = (to_both[:, :HIDDEN] / counts)[doc] + to_both[doc, HIDDEN:] * (hidden == top[doc])
        to_hidden *= hidden > 0
        to_max = (to_hidden @ self.dense.T) * (maxima > 0)
        steps = np.arange(WIDTH)
        seen = x[where[..., None] + steps].reshape(*where.shape, WIDTH * CHANNELS)
        to_seen = to_max[..., None] * self.filters.T[None]
        to_bytes = np.zeros((PAD + 1, CHANNELS), dtype=np.float32)
        padded = np.append(symbols, np.full(WIDTH, PAD, dtype=np.int16))
        np.add.at(to_bytes, padded[where[..., None] + steps].ravel(), to_seen.reshape(-1, CHANNELS))
        to_bytes[PAD] = 0
        return {
            "bytes": to_bytes[:, :-1],
            "filters": np.einsum("cfk,cf->kf", seen, to_max, optimize=True),
            "bias": to_max.sum(axis=0),
            "dense": active.T @ to_hidden,
            "dense_bias": to_hidden.sum(axis=0),
            "out": both.T @ wrong,
            "out_bias": wrong.sum(keepdims=True),
        }

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 4) -> Network:
        """Adam over shuffled batches, STEPS at least, the rate falling to a twentieth."""
        epochs = max(epochs, -(-STEPS // -(-len(texts) // batch)))
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        total, t = epochs * -(-len(texts) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for low in range(0, len(order), batch):
                rows, t = order[low : low + batch], t + 1
                now = rate * (1 - 0.95 * t / total)
                for n, g in self.gradients([texts[i] for i in rows], labels[rows]).items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    step = first[n] / (1 - 0.9**t) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - now * step).astype(np.float32))
        return self


def held_out(doc_id: str) -> F.Column:
    """Rows whose crc32 of the id as text is divisible by 5; null ids are."""
    crc = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    return crc % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, rows: int, most_bytes: int, seed: int) -> list[tuple[bytes, float]]:
    """(text, label) of labelled rows outside the held-out fold, in the order of a hash of id and text.

    They are the first `rows` of that order, or as many as have `most_bytes` together (one at least); texts of any length
    are drawn alike, and repeated ids bring no more. Null texts count as empty.
    """
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).select("doc_id", "quality")
    n, near = marked.count(), unit_hash("doc_id", seed=seed)
    marked = marked.where(near < F.lit(min(1.0, 2 * rows / max(n, 1) + 0.01))).orderBy(near, "doc_id", "quality").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marked), "doc_id").withColumns({"near": near, "own": F.xxhash64(F.lit(seed), "text")})  # marked has `rows` rows at most
    drawn = first_texts(found, ["near", "own", "doc_id", "quality"], "text", rows, most_bytes)
    return [(r["text"].encode(), float(r["quality"])) for r in drawn]


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, seed: int = 9
) -> Network:
    """A network trained on at most `rows` labelled rows outside the held-out fold, chosen by hash, with `most_bytes` of text at most.

    Repeated ids and rows each count as a row. Without any such row the network stays as drawn, with a neutral score of
    0.5 for every text.
    """
    drawn = training_rows(docs, labels, text, doc_id, rows, most_bytes, seed)
    network = Network()
    if not drawn:
        network.out[:] = 0
        return network
    return network.train([t for t, _ in drawn], np.array([q for _, q in drawn], dtype=np.float32))


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Add score (0 to 1) to every row, by the whole text.

    Null texts are scored as empty ones. Repeated rows get equal scores. An input column named score is
    replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        worker_memory("classifier")
        return pd.Series(network.predict([t.encode() if t else b"" for t in texts]), index=texts.index)

    return docs.withColumn("score", of(F.col(f"`{text}`")))
