"""Quality rules: isolation forests over rule statistics, with thresholds set on labelled rows.

The statistics of a document are made into ratios, in families: its words (length, symbols, capitals, variety), its
repetitions (repeated lines and word windows) and its size (words, words of a line). Each family has a forest: trees of
random splits, each grown on a few rows, isolate unusual documents after few splits. The rows that fall into each leaf
are counted over the whole table, which gives the leaf its depth; the mean depth gives a score between 0 and 1. A
family's threshold is the score that makes the fewest errors on all those labelled rows that the base rules and the
families before it let pass, among the scores that keep KEEP_GOOD of the good ones; a family whose unusual documents are
no worse than others thus rejects none. A document is kept if no family rejects it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.common import by_bytes, fresh_names, numbered_words, settle_table, unit_hash, worker_memory
from rowforge.llm.substring import CHUNK, chunks

#: Rows from which the trees draw their splits (TREES * SUBSAMPLE), and the steps of a score at which labelled rows are counted.
SPLIT_ROWS, STEPS = 4096, 1 << 16
#: Small samples keep a tenth of bad rows few enough in each tree to be isolated early.
TREES, SUBSAMPLE = 128, 32
KEEP_GOOD = 0.985
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_distinct")


_KINDS = np.zeros((256, 4), dtype=bool)
_KINDS[[32, 9, 10, 11, 12, 13], 0] = True
_KINDS[[ord(c) for c in SYMBOLS], 1] = True
_KINDS[ord("A") : ord("Z") + 1, 2] = True
_KINDS[0x80:0xC0, 3] = True  # continuation bytes are no code points of their own


def repeated_windows(ids: np.ndarray, doc: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Where the windows of `width` words stand whose words come once more in the same document.

    Windows are told apart by the numbers of their words, one word more at a time; a window whose beginning comes once
    only is left aside from there on.
    """
    at = np.arange(max(len(ids) - width + 1, 0))
    at = at[doc[at] == doc[at + width - 1]]
    kind = doc[at].astype(np.int64)
    for step in range(width):
        if not len(at):
            break
        key = kind * (int(ids.max()) + 1) + ids[at + step]
        _, kind, many = np.unique(key, return_inverse=True, return_counts=True)
        again = many[kind] > 1
        at, kind = at[again], kind[again]
    return at


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """STATS of each text; null counts as empty."""
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in STATS}
    raw = [(t or "").encode() for t in texts]
    for low, high in chunks(raw):
        part = raw[low:high]
        ids, doc, different = numbered_words(part)
        n = high - low
        out["n_words"][low:high] = np.bincount(doc, minlength=n)
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in part])
        starts = ends - [len(t) for t in part]
        for k, name in enumerate(("space", "n_symbols", "n_capitals", "tail")):
            sums = np.concatenate(([0], np.cumsum(_KINDS[data, k])))
            count = sums[ends] - sums[starts]
            if name == "space":
                out["word_chars"][low:high] += ends - starts - count
            elif name == "tail":
                out["word_chars"][low:high] -= count
            else:
                out[name][low:high] = count
        out["n_distinct"][low:high] = np.bincount(np.unique(doc * max(different, 1) + ids) // max(different, 1), minlength=n)
        first = repeated_windows(ids, doc)
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + REPEAT_WINDOW, -1)
        out["n_repeat_words"][low:high] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
        for i in range(n):
            if b"\n" in part[i]:
                lines = [x for x in part[i].split(b"\n") if x and x.split()]
                out["n_lines"][low + i] = len(lines)
                out["n_dup_lines"][low + i] = len(lines) - len(set(lines))
            else:
                out["n_lines"][low + i] = int(bool(part[i].split()))
    return out


FAMILIES = ("words", "repetitions", "size")


def ratios(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The features of each family, one row for each document; capped, so that all heavy cases lie together."""
    words, chars, lines = (np.maximum(stats[n], 1) for n in ("n_words", "word_chars", "n_lines"))
    families = {
        "words": [
            np.clip(stats["word_chars"] / words, 2.0, 12.0),
            np.minimum(stats["n_symbols"] / words, 0.4),
            np.minimum(stats["n_capitals"] / chars, 0.4),
            np.maximum(np.log1p(stats["n_distinct"]) / np.log1p(words), 0.6),
        ],
        "repetitions": [stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words],
        "size": [np.log1p(stats["n_words"]), np.log1p(words / lines)],
    }
    return {name: np.column_stack(columns).astype(np.float64) for name, columns in families.items()}


@dataclass
class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, left child (the right one follows), depth at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    norm: float = 1.0

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = 5) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        limit = int(np.ceil(np.log2(max(size, 2)))) + 2
        forest = cls(norm=max(cls._expected(size), 1e-9))
        for _ in range(trees if size else 0):
            rows = x[rng.choice(len(x), size, replace=False)]
            nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
            open_nodes = [(0, rows, 0)]
            while open_nodes:
                at, part, depth = open_nodes.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                able = np.flatnonzero(high > low)
                if depth >= limit or len(part) < 2 or not len(able):
                    nodes[at] = [-1, 0.0, 0, depth + cls._expected(len(part))]
                    continue
                f = int(rng.choice(able))
                cut = float(rng.uniform(low[f], high[f]))
                left = part[:, f] < cut
                nodes[at] = [f, cut, len(nodes), 0.0]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                open_nodes += [(len(nodes) - 2, part[left], depth + 1), (len(nodes) - 1, part[~left], depth + 1)]
            f, cut, child, depth = (np.array(v) for v in zip(*nodes, strict=True))
            forest.trees.append((f.astype(np.int64), cut, child.astype(np.int64), depth))
        return forest

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        """For each tree the node where every row ends."""
        return [self._ends(tree, x) for tree in self.trees]

    @staticmethod
    def _ends(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        f, cut, child, _ = tree
        at = np.zeros(len(x), dtype=np.int64)
        while len(inner := np.flatnonzero(f[at] >= 0)):
            here = at[inner]
            at[inner] = child[here] + (x[inner, f[here]] >= cut[here])
        return at

    def weighed(self, counts: list[np.ndarray], size: int = SUBSAMPLE) -> IsolationForest:
        """The same splits, with the depth of each leaf by its share of all rows: `counts` has those of each tree's nodes."""
        out = IsolationForest(norm=self.norm)
        for (f, cut, child, _), count in zip(self.trees, counts, strict=True):
            level = np.zeros(len(f))
            for at in np.flatnonzero(f >= 0):  # parents come before their children
                level[child[at]] = level[child[at] + 1] = level[at] + 1
            within = count * (min(size, count.sum()) / max(count.sum(), 1))
            more = np.array([self._expected(n) if n >= 2 else 0.0 for n in within])
            out.trees.append((f, cut, child, np.where(f < 0, level + more, 0.0)))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; 0.5 where there are no trees."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree[3][self._ends(tree, x)]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def threshold(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score at or above which a document is rejected; 1.1 (none is) where that makes no fewer errors.

    It lies halfway between the scores of the rows that it parts.
    """
    values, at = np.unique(scores, return_inverse=True)
    return threshold_of(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)), keep_good)


def threshold_of(values: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """threshold() from the ascending scores and how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return 1.1
    cuts = np.append((values[1:] + values[:-1]) / 2, 1.1)
    missed = np.cumsum(bad)
    lost = good.sum() - np.cumsum(good)
    errors = np.where(lost <= (1 - keep_good) * good.sum(), lost + missed, good.sum() + bad.sum() + 1)
    return float(cuts[len(cuts) - 1 - int(np.argmin(errors[::-1]))])


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass
class Judgement:
    """A forest and a threshold for each family."""

    forests: dict[str, IsolationForest]
    limits: dict[str, float]

    def anomaly(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """The largest share of a family's threshold that a document reaches; rejected at 1 or more."""
        x = ratios(stats)
        return np.max([self.forests[n].score(x[n]) / self.limits[n] for n in FAMILIES], axis=0)


def _statistics_table(rows: DataFrame, own: list[str], shown: tuple[str, ...], more: str = "", work=None) -> DataFrame:
    """The columns `own` of rows, whose last column is the text, with the statistics `shown` and what `work` makes of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("rules")
        for batch in by_bytes(batches, -1, CHUNK):
            stats = statistics(batch.column(batch.num_columns - 1).to_pylist())
            made = {n: stats[n] for n in shown} | (work(stats) if work else {})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made.values())], names=[*own, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, *[f"{n} long" for n in shown], *([more] if more else [])]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 3) -> Judgement:
    """Forests whose leaves are weighed by all rows, and thresholds from all labelled ones.

    The statistics of all texts are taken once, on executors, and kept as a narrow table. The driver gets those of the
    SPLIT_ROWS rows of the smallest hashes, from which the trees draw their splits, then counts: rows of each leaf, and
    good and bad rows at each of STEPS scores, however many rows there are. A repeated id brings each of its rows with
    each of its labels.
    """
    key, body = F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")
    rows = docs.select(key, unit_hash(key, body, seed=seed).alias("near"), body)
    measured = settle_table(_statistics_table(rows, ["doc_id", "near"], STATS))
    passed = (F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words"))  # as base_failed()

    drawn = measured.orderBy("near", *STATS).limit(SPLIT_ROWS).select(*STATS).collect()
    drawn = np.array([[int(v) for v in r] for r in drawn], dtype=np.int64).reshape(len(drawn), len(STATS))
    drawn = drawn[np.lexsort(drawn.T)] if len(drawn) else drawn  # the same forest whatever the order of arrival
    stats = dict(zip(STATS, drawn.T, strict=True))
    x, fine = ratios(stats), ~base_failed(stats)
    grown = {n: IsolationForest.grow(x[n][fine], seed=seed + i) for i, n in enumerate(FAMILIES)}

    def features(part: pd.DataFrame) -> dict[str, np.ndarray]:
        return ratios({n: part[n].to_numpy() for n in STATS})

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(n, t): np.zeros(len(tree[0]), dtype=np.int64) for n in FAMILIES for t, tree in enumerate(grown[n].trees)}
        for part in parts:
            values = features(part)
            for n in FAMILIES:
                for t, ends in enumerate(grown[n].leaves(values[n])):
                    sums[n, t] += np.bincount(ends, minlength=len(sums[n, t]))
        for (n, t), count in sums.items():
            yield pd.DataFrame({"family": n, "tree": t, "node": np.flatnonzero(count), "rows": count[count > 0]})

    leaves = measured.where(passed).select(*STATS).mapInPandas(counted, "family string, tree int, node long, rows long")
    counts = {n: [np.zeros(len(tree[0]), dtype=np.int64) for tree in grown[n].trees] for n in FAMILIES}
    for r in leaves.groupBy("family", "tree", "node").agg(F.sum("rows").alias("rows")).collect():
        counts[r["family"]][r["tree"]][r["node"]] = r["rows"]
    forests = {n: grown[n].weighed(counts[n]) for n in FAMILIES}

    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    good = F.count_if(F.col("quality") == 1)
    marked = marked.groupBy("doc_id").agg(good.alias("good"), (F.count("*") - good).alias("bad"))
    steps = [f"s_{n}" for n in FAMILIES]

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = features(part)
            made = {f"s_{n}": np.floor(forests[n].score(values[n]) * STEPS).astype(np.int64) for n in FAMILIES}
            yield pd.DataFrame({"good": part["good"], "bad": part["bad"], **made})

    found = measured.where(passed).join(marked, "doc_id").select("good", "bad", *STATS)
    found = settle_table(found.mapInPandas(scored, ", ".join(f"{c} long" for c in ("good", "bad", *steps))))
    limits: dict[str, float] = {}
    for n in FAMILIES:
        step = f"s_{n}"
        at = found.groupBy(step).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(step).collect()  # STEPS at most
        at = np.array([[int(v) for v in r] for r in at], dtype=np.int64).reshape(-1, 3)
        limits[n] = threshold_of((at[:, 0] + 0.5) / STEPS, at[:, 1], at[:, 2])
        found = found.where((F.col(step) + 0.5) / STEPS < limits[n])
    return Judgement(forests, limits)


def judge(docs: DataFrame, judgement: Judgement, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly and kept to every row.

    Null and blank texts have all counts 0 and fail the base rules. Repeated rows are judged alike. Input columns with
    the names of result columns, and the text itself, are not returned; all others are, whatever their names. An empty
    table gives an empty result.
    """
    shown = STATS[:5]
    new = {*shown, "base_failed", "anomaly", "kept", text.lower()}
    own = [c for c in docs.columns if c.lower() not in new]

    def verdict(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        anomaly, failed = judgement.anomaly(stats), base_failed(stats)
        return {"base_failed": failed, "anomaly": anomaly, "kept": ~failed & (anomaly < 1)}

    (body,) = fresh_names(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias(body))
    return _statistics_table(rows, own, shown, "base_failed boolean, anomaly double, kept boolean", verdict)
