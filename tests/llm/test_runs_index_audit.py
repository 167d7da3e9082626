"""Periodic runs, the inverted multi-index and the filter audit against brute force and their edge cases."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from rowforge.llm import audit, multi_index, periodic

TEXTS = [
    None, "", " \t\n", "a", "a a a a a a", "a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "é é é é é é é", "one two three",
    "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "p q r s t u v w",
]


def brute_runs(words, least=6, times=4):
    """Every stretch that repeats itself q words on, as long as it goes, for every q; the smallest period of each counts."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q):
                part = words[start : start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.add((start, length, q))
            i = max(i, start + 1) if i > start else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def random_texts(rng, n):
    out = []
    for _ in range(n):
        words = [rng.choice(rng.choice(["ab", "abc", "a", "abcdefgh"])) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(3, 9)
            for i in range(a, len(words)):
                words[i] = words[a + (i - a) % p]
        out.append(" ".join(words * (rng.randint(1, 5) if rng.random() < 0.2 else 1)))
    return out


@pytest.mark.parametrize("least, times", [(6, 4), (4, 2), (2, 2), (6, 3), (12, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(60):
        texts = random_texts(rng, 8)
        many, runs, left = periodic.search(texts, least, times)
        for text, n, found, kept in zip(texts, many, runs, left, strict=True):
            words = text.split()
            assert n == len(words) and found == brute_runs(words, least, times) and kept == collapsed(words, found)


def test_words_are_told_apart_by_bytes():
    """Two words of a Thue-Morse sequence, which polynomial hashes confuse, are no period."""
    one, two = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    assert periodic.search([" ".join([one, two, one, one, two, two, one, two, two])])[1] == [[]]
    assert periodic.search([" ".join([one, two] * 4)])[1] == [[(0, 8, 2)]]


def test_ordered_sets_on_both_sides_of_the_switch():
    rng = random.Random(5)
    for sizes in ((1, 1), (3, 2, 1), (periodic.FEW - 1, 200), (periodic.FEW, 200), (100, 90, 80)):
        values = rng.sample(range(1000), sum(sizes))
        sets = [sorted(values[sum(sizes[:i]) : sum(sizes[: i + 1])]) for i in range(len(sizes))]
        owner = {v: i for i, s in enumerate(sets) for v in s}
        whole = sorted(values)
        want = [(a, b) for a, b in zip(whole, whole[1:], strict=False) if owner[a] != owner[b]]
        merged, fresh = periodic.united([list(s) for s in sets])
        assert merged == whole and sorted(fresh) == want


def test_long_periodic_texts():
    for words, want in (
        (["a"] * 60_000, [(0, 60_000, 1)]),
        ([f"w{i % 5000}" for i in range(60_000)], [(0, 60_000, 5000)]),
        ([w for i in range(10_000) for w in ("a", "b", "c", "d", "e", f"w{i}")], []),
    ):
        assert periodic.search([" ".join(words), "b"])[1] == [want, []]


def test_collapse(spark):
    rows = [(i, t, i, f"k{i}") for i, t in enumerate(TEXTS)] + [(1, "a a a a a a", 0, "z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, body string").repartition(3)
    out = periodic.collapse(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "body", "n_words", "runs", "collapsed"}
    for r in out:
        if r["body"] != "z":
            words = (TEXTS[r["doc_id"]] or "").split()
            want = brute_runs(words)
            assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words) and r["collapsed"] == collapsed(words, want)
    assert periodic.collapse(df.limit(0)).count() == 0


def unit(rng, n, dims):
    x = rng.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_components(vectors, labels, ids, cosine):
    """(links, component_id) by all pairs."""
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    peers = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and labels[i] is not None and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    peers[i].append(j)
                    peers[j].append(i)
    out = [None] * n
    for i in range(n):
        if out[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in peers[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            named = [ids[j] for j in group if ids[j] is not None]
            for j in group:
                out[j] = (len(peers[j]), min(named) if named else None)
    return out


def clusters(seed, n, dims=8):
    """Chains and groups of near vectors, copies, multiples, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    centres = unit(rng, 12, dims)
    x = [(centres[rng.integers(12)] + rng.standard_normal(dims) * rng.choice([0.02, 0.06, 0.2])).astype(np.float32).astype(float).tolist() for _ in range(n)]
    for i in range(0, n, 9):
        x[i] = list(x[i - 1])
    for i in range(0, n, 11):
        x[i] = [4 * v for v in x[i - 2]]
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [1.0], [2.0], [-0.0] * dims, [1e30] + [0.0] * (dims - 1), [1e-30] + [0.0] * (dims - 1)]
    x += odd
    labels = [None if rng.random() < 0.05 else int(rng.integers(3)) for _ in range(n)] + [0] * len(odd)
    return x, labels


@pytest.mark.parametrize("seed, shard, askers", [(1, multi_index.SHARD, multi_index.ASKERS), (2, 16, 24), (3, 5, 7)])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, seed, shard, askers):
    monkeypatch.setattr(multi_index, "SHARD", shard)
    monkeypatch.setattr(multi_index, "ASKERS", askers)
    x, labels = clusters(seed, 160)
    ids = [None if i % 37 == 5 else 1000 - i for i in range(len(x))]
    rows = [(i, v, k, "extra", 1) for i, v, k in zip(ids, x, labels, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, digest string, cid int").repartition(3)
    got = sorted(tuple(r) for r in multi_index.near_duplicates(df).na.fill(-1).collect())
    want = brute_components(x, labels, ids, 0.98)
    assert got == sorted((-1 if i is None else i, n, -1 if c is None else c, i == c) for i, (n, c) in zip(ids, want, strict=True))


def test_doubles_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1e200, 1e200], 1), (2, [1e-200, 1.0e-200], 1), (3, [1.0, -1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in multi_index.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in multi_index.near_duplicates(df.withColumn("label", df.label.cast("string")).where("vec_id = 3")).collect()) == [(3, 0, 3, True)]


def test_traversal_loses_no_link():
    """For every pair at the threshold the cell of the one is visited by the other; a plain heap visits the same cells."""
    import heapq

    rng = np.random.default_rng(3)
    x = unit(rng, 600, 16)
    index = multi_index.fit(x, 12, 0.98)
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    r, c = index.visits(x)
    visited = set(zip(r.tolist(), c.tolist(), strict=True))
    assert all((i, cell) in visited for i, cell in enumerate(index.cells(y).tolist()))
    assert all((i, cell) in visited for i, cell in enumerate(index.cells(x).tolist()))
    assert len(visited) < 0.7 * len(x) * 144
    a, b = (index.bounds(h, book) ** 2 for h, book in zip(index.halves(x), (index.first, index.second), strict=True))
    for i in range(20):
        order_a, order_b, seen, found = np.argsort(a[i]), np.argsort(b[i]), {(0, 0)}, set()
        heap = [(0.0, 0, 0)]
        while heap:
            far, p, q = heapq.heappop(heap)
            if far > (index.reach + multi_index.SLACK) ** 2:
                break
            found.add((i, int(order_a[p]) * len(index.second) + int(order_b[q])))
            for s, t in ((p + 1, q), (p, q + 1)):
                if s < len(order_a) and t < len(order_b) and (s, t) not in seen:
                    seen.add((s, t))
                    heapq.heappush(heap, (a[i][order_a[s]] + b[i][order_b[t]], s, t))
        assert found == {v for v in visited if v[0] == i}


def test_recall_below_one_visits_less():
    x = unit(np.random.default_rng(4), 600, 16)
    whole, part = multi_index.fit(x, 12, 0.98), multi_index.fit(x, 12, 0.98, recall=0.9)
    assert part.reach < whole.reach and len(part.visits(x)[0]) < len(whole.visits(x)[0])


WORDS = [f"w{i}" for i in range(70)]
DOCS = [
    (1, " ".join(WORDS), "s1"), (2, " ".join(WORDS), "s1"), (3, None, "s1"), (4, "", None), (5, "", ""), (6, "a b " * 40, "s2"), (7, "ABC DEF " * 40, "s2"),
    (8, " ".join(WORDS) + " #", "s2"), (8, " ".join(WORDS) + " #", "s2"), (None, " ".join(WORDS), "s2"), (None, None, None), (9, " ".join(WORDS) + " é" + "É" * 300, "s3"),
    (10, "\t\n", "s1"), (11, "A" * 1000, "s1"), (12, " ".join(WORDS), "s3"), (0, "x " * 100_000, "s1"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, 1), (7, 1, 1), (8, 1, None), (12, None, None), (99, 1, 1), (None, 1, 1)]


def brute_audit(docs, labels):
    good, toxic = ({d for d, *m in labels if d is not None and m[k] == 1} for k in (0, 1))
    rows = []
    for doc_id, text, part in docs:
        t = text or ""
        w = t.encode().split()
        capitals = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t)
        smaller = any((u or "") == t and i is not None and doc_id is not None and i < doc_id for i, u, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * capitals > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        rows.append((part or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][:-1], total[out[key][-1]])
    return out


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, source string, part string, row int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit_texts(docs, labels).collect()}
    assert got == brute_audit(DOCS, LABELS) and len(got) == 600 * 4
    assert audit.audit_texts(docs.limit(0), labels).count() == 0
    assert {tuple(r)[:3]: tuple(r)[7:9] for r in audit.audit_texts(docs, labels.limit(0)).collect()} == dict.fromkeys(got, (0, 0))


def test_audit_of_any_filters(spark):
    rows = spark.createDataFrame([(i, "p") for i in range(10)], "row long, part string")
    ids = lambda *which: spark.createDataFrame([(i,) for i in which], "row long")
    got = {tuple(r)[1:3]: tuple(r)[3:] for r in audit.audit(rows, {"x": ids(1, 2, 3), "y": ids(3, 4)}, {"lost": ids(2, 4)}).collect()}
    assert got == {("xy", 1): (7, 3, 0, 2, 1, 5), ("xy", 2): (6, 1, 1, 1, 1, 3), ("yx", 1): (8, 2, 0, 1, 1, 3), ("yx", 2): (6, 2, 1, 2, 1, 5)}
    with pytest.raises(ValueError):
        audit.audit(rows, {}, {})


def planted(doc_id, text):
    """The words that op11 looks at."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def test_op11_query(spark):
    from rowforge.llm import queries
    from tests.conftest import DATA

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, DATA).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        words = planted(r["doc_id"], texts[r["doc_id"]])
        runs = [tuple(x) for x in periodic.search([" ".join(words)])[1][0]] if len(words) > 1500 else brute_runs(words)
        start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want = (len(runs), start, length, period, None if length is None else 1000 * length // period, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(collapsed(words, runs)))
        assert tuple(r)[1:] == want


def test_planting(spark):
    from rowforge.llm.queries import with_planted_period

    rng = random.Random(2)
    rows = [(i, " ".join(f"{rng.randrange(50)}é" for _ in range(rng.choice([0, 1, 2, 3, 7, 40, 200])))) for i in range(400)] + [(None, "a b"), (None, None), (16, None)]
    out = with_planted_period(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").split()) for r in out)) == sorted(((i is None, i or 0, planted(i, t) if i is not None else (t or "").split()) for i, t in rows))
