"""Guidance texts, stores that a crash interrupts, deep trees, long chains, running quotas in ranges."""

import random

import pytest
from pyspark.sql import functions as F

from rowforge.functions import fields, text
from rowforge.operators import generate, greedy, vocab
from rowforge.sources import tables as src

STATED = [
    # a number or a range and what it counts, with up to three words between
    ("Titel mit 4 Wörtern", True), ("Zwischen 40–80 Zeichen bleiben", True), ("about 12 words", True), ("Bitte 7 kurze klare gute Begriffe", True),
    ("7 kurze klare gute neue Begriffe", False), ("neun Stichworte", True), ("at most 2 sentences", True), ("3 - 5 keywords", True), ("10 Saetze", True),
    ("Version 2.5 Zeichen", True), ("5, besser Wörter", False), ("5x Wörter", False), ("H2 Wörter", False), ("acht Seiten", False),
    # one
    ("Antworte mit einem kurzen Satz", True), ("ein Wort genügt", True), ("eines der Wörter", True), ("ein Schlagwort", False), ("einer der guten Sätze", False),
    # grades, levels and ages
    ("Begriffe für Klasse 9", False), ("Klasse 9 Begriffe", False), ("Klassen 7, 8 Begriffe", True), ("Klassen 7 bis 9 und 11 Begriffe", False), ("Lektion 3/4 Wörter", False),
    ("Oberstufe 2 Begriffe", False), ("Niveau eins Wörter", False), ("8 Jahre Begriffe", False), ("8-10 Jahren Begriffe", False), ("Klasse 9, dazu 2 Begriffe", True),
    ("drei Klasse 9 Begriffe", True), ("Klasse: 9 Begriffe", True),
    # nothing
    ("", False), ("Kurz und klar.", False), ("Zeichen 5", False),
]


def test_stated_lengths(spark):
    assert [fields.states_a_length(g) for g, _ in STATED] == [want for _, want in STATED]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(STATED)] + [(99, None)], "i int, g string")
    got = {r["i"]: r["s"] for r in df.select("i", fields.length_is_stated("g").alias("s")).collect()}
    assert [got[i] for i in range(len(STATED))] == [want for _, want in STATED] and got[99] is False


def test_typical_phrases(spark):
    df = spark.createDataFrame([(40, 90, None, None), (10, 10, 2, 3), (None, None, None, None)], "a long, b long, c long, d long")
    columns = [F.col(c) for c in "abcd"]
    plain, listed = fields.TextField("x"), fields.TextField("x", ",")
    assert [r[0] for r in df.select(fields.typical_phrases(plain, *columns)).collect()] == ["im Datensatz meist 40–90 Zeichen", "im Datensatz meist etwa 10 Zeichen", ""]
    assert [r[0] for r in df.select(fields.typical_phrases(listed, *columns)).collect()] == ["im Datensatz meist 40–90 Zeichen", "im Datensatz meist 2–3 Werte", ""]
    told = fields.TextField("x", guidance="Höchstens 9 Wörter.")
    assert {r[0] for r in df.select(fields.typical_phrases(told, *columns)).collect()} == {""}


def test_masks_with_and_without_signs(spark):
    cells = ["plain", None, "", "a@b.org and c@d.org", "http://x.y/z.", "www.x.y 0", "call +49 123 4567 or (030) 123456", "@someone 00", "0", "a@b", "x@y.de@handle @real_one"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    want = df.select(text.cell("t").alias("t"))
    for kind, pattern, _ in text.MASKS:
        want = want.select(F.regexp_replace("t", pattern, f"[{kind}]").alias("t"))
    assert [r[0] for r in df.select(text.scrub(text.cell("t"))).collect()] == [r[0] for r in want.collect()]
    counts = [r[0].asDict() for r in df.select(text.pii_counts(text.cell("t"))).collect()]
    masked = [r[0] for r in want.collect()]
    assert [{k: m.count(f"[{k}]") for k in c} for c, m in zip(counts, masked, strict=True)] == counts


def test_store_survives_a_broken_save(spark, tmp_path):
    store = src.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1,)], "a int")
    store.save(df, "one")
    store._move(f"{store.root}/one", f"{store.root}/one.old")  # where a save that stopped half-way leaves it
    assert [x["name"] for x in store.list()] == ["one"] and store.load("one").count() == 1
    store.save(df.unionAll(df), "one", source="one")
    assert store.load("one").count() == 2 and len(store.history("one")) == 2
    with pytest.raises(ValueError):
        store.save(df, "one.old")


def test_bad_line_is_named_within_its_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        lines = ['{"a": 1}'] * 40 + (["{broken"] if i == 1 else []) + ['{"a": 2}'] * 5
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="Line 41 of .*1.jsonl"):
        src.read_jsonl(spark, str(tmp_path / "in"))


def test_large_vocabularies_are_walked_by_levels(spark, monkeypatch):
    rows = [("r", "R", None, 1), ("a", "A", "r", 1), ("b", "B", "r", 2), ("c", "C", "a", 1), ("x", "X", "y", 1), ("y", "Y", "x", 1), ("c", "C", "b", 1)]
    df = spark.createDataFrame(rows, "uri string, label string, broader string, ord long")
    shown = lambda: sorted((r["uri"], r["depth"], r["anchor"], r["position"], tuple(r["path"])) for r in vocab.tree(df, "T").collect())
    recursive = shown()
    monkeypatch.setattr(vocab, "RECURSIVE_ROWS", 1)
    assert shown() == recursive and len(recursive) == 5


def test_long_chains_of_links(spark):
    n = 12
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "id long")
    assert sorted(r["id"] for r in greedy.first_independent(nodes, edges).collect()) == list(range(0, n + 1, 2))


def test_quota_in_ranges(spark):
    rng = random.Random(4)
    edges = [(i, f"l{l}", rng.random(), 1 + rng.randrange(3)) for i in range(400) for l in range(3) if l == 0 or rng.random() < 0.3]
    quota = {"l0": 57, "l1": 20, "l2": 1}
    order = {}
    for i, _, o, _ in edges:
        order.setdefault(i, o)
    rows = [(i, label, order[i], quota[label], w) for i, label, _, w in edges]
    taken, held = set(), dict.fromkeys(quota, 0)
    for i in sorted(order, key=lambda i: (order[i], i)):
        own = [(label, w) for j, label, _, _, w in rows if j == i]
        if any(held[label] < quota[label] for label, _ in own):
            taken.add(i)
            for label, w in own:
                held[label] += w
    df = spark.createDataFrame(rows, "item long, label string, ord double, quota int, weight int").repartition(6)
    assert {r["item"] for r in greedy.quota_items(df).collect()} == taken


def test_items_beyond_the_quota_keep_none_from_being_new(spark, monkeypatch):
    rows = [
        ("A", 0, "t0", [1.0, 0.0, 0.0]), ("A", 1, "t1", [0.0, 1.0, 0.0]), ("B", 2, "t1", [0.0, 0.0, 1.0]), ("B", 3, "t3", [0.0, 1.0, 0.1]),
        ("C", 4, "t4", [1.0, 1.0, 1.0]),
    ]
    given = spark.createDataFrame([(label, o, t, "long enough", "k", v) for label, o, t, v in rows], "label string, ord long, title string, description string, keywords string, v array<double>")
    needed = spark.createDataFrame([("A", 1), ("B", 2), ("C", 0)], "label string, needed long")
    from rowforge.operators import vectors

    compared = []
    monkeypatch.setattr(vectors, "similar_pairs", lambda *a, plain=vectors.similar_pairs, **k: compared.append(1) or plain(*a, **k))
    out = generate.accept(given, "v", needed, (5, 50))
    assert len(compared) == 1  # however many rounds the quotas take
    assert {r["ord"]: r["verdict"] for r in out.collect()} == {0: "passed", 1: "over_quota", 2: "passed", 3: "passed", 4: "over_quota"}
