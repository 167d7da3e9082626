import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.functions import text as tx
from rowforge.functions.fields import TextField, merge_values, states_a_length, typical_phrase
from rowforge.operators import combine, greedy, labels, split, vectors, vocab


def greedy_twin(items, quota):
    """The sequential rule, for comparison."""
    count, taken = {}, []
    for item, weights in items:
        if any(count.get(lab, 0) < quota[lab] for lab in weights):
            taken.append(item)
            for lab, w in weights.items():
                count[lab] = count.get(lab, 0) + w
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_greedy_quota_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    items = [(i, {f"l{rng.randrange(5)}": rng.randint(1, 3) for _ in range(rng.randint(1, 3))}) for i in range(120)]
    quota = {f"l{k}": rng.randint(1, 9) for k in range(5)}
    rows = [(i, lab, i, quota[lab], w) for i, weights in items for lab, w in weights.items()]
    edges = spark.createDataFrame(rows, "item int, label string, ord int, quota int, weight int")
    want = greedy_twin(items, quota)
    assert sorted(r["item"] for r in greedy.quota_items(edges).collect()) == want
    assert sorted(r["item"] for r in greedy.quota_items(edges, 9).collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_first_independent_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for i in range(40):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    nodes = spark.range(40)
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    for local, rounds in ((greedy.LOCAL_LINKS, greedy.ROUNDS), (0, 99), (5, 1), (20, 0), (1, 0)):
        assert sorted(r["id"] for r in greedy.first_independent(nodes, edges, local, rounds).collect()) == kept


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_chain_takes_a_few_dozen_jobs(spark):
    n = 10_000
    edges, nodes = spark.range(n).selectExpr("id AS a", "id + 1 AS b"), spark.range(n + 1)
    for name, local in (("whole", greedy.LOCAL_LINKS), ("ranges", 4_000)):
        kept, jobs = jobs_of(spark, f"chain {name}", lambda local=local: greedy.first_independent(nodes, edges, local, rounds=1).agg(F.count("*"), F.sum("id"), F.max(F.col("id") % 2)).first())
        assert tuple(kept) == (n // 2 + 1, sum(range(0, n + 1, 2)), 0) and jobs < 60


def test_a_hub_with_more_links_than_a_pass_takes(spark):
    edges = spark.range(300).selectExpr("id AS a", "300L AS b").unionByName(spark.range(301, 400).selectExpr("300L AS a", "id AS b"))
    kept = greedy.first_independent(spark.range(400), edges, local=10, rounds=0)
    assert sorted(r["id"] for r in kept.collect()) == [*range(300), *range(301, 400)]


def test_learnable(spark):
    rows = [(i, "all") for i in range(10)] + [(i, "half") for i in range(5)] + [(0, "rare")]
    edges = spark.createDataFrame(rows, "item int, label string")
    keep, effective = greedy.learnable(edges, 10, 2)
    # "all" is on every row and teaches nothing; without it only five rows are left, all "half"; then nothing is.
    assert [r["label"] for r in keep.collect()] == [] and effective == 0


def test_clean_text_and_scrub(spark):
    cases = {
        "a &amp; <b>b</b>  c": "a & b c", "x < y > z": "x < y z", "[t](u) **w**": "t w", None: "", "\x00a\tb": "a b", "![i](u)": "i",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", tx.clean_text(F.col("t")).alias("c")).collect()}
    assert got == cases
    pii = {
        "mail a.b@x.org now": "mail [email] now", "see https://x.org/a.": "see [url].", "call +49 30 1234567": "call [phone]", "im Jahr 2020": "im Jahr 2020",
        "am 01.02.2026": "am 01.02.2026", "by @someone_x": "by [handle]", "ISBN 978-3-16-148410-0": "ISBN 978-3-16-148410-0", "(030) 123456": "[phone]",
    }
    df = spark.createDataFrame([(k,) for k in pii], "t string")
    got = {r["t"]: (r["s"], r["again"]) for r in df.select("t", tx.scrub(F.col("t")).alias("s"), tx.scrub(tx.scrub(F.col("t"))).alias("again")).collect()}
    assert got == {k: (v, v) for k, v in pii.items()}
    keyed = spark.createDataFrame([("École",), ("ecole",), ("ecola",)], "t string").select(tx.dedupe_key(F.col("t")).alias("k"))
    assert len({r["k"] for r in keyed.collect()}) == 2


def test_fields(spark):
    with pytest.raises(ValueError):
        TextField("a", "")
    with pytest.raises(ValueError):
        TextField("a", None, 2)
    field = TextField("a", ",", 3)
    df = spark.createDataFrame([(" x, ,y,x ",), (None,)], "a string")
    rows = df.select(field.normal().alias("n"), field.is_gap().alias("g"), F.size(merge_values(field.values(), F.array(F.lit("Y"), F.lit("z")))).alias("m")).collect()
    assert [tuple(r) for r in rows] == [("x, y, x", False, 4), ("", True, 2)]
    assert states_a_length("100-400 Zeichen") and not states_a_length("für Klasse 5 geeignete Begriffe")
    assert typical_phrase((40, 90), None, False) == "im Datensatz meist 40–90 Zeichen"


def training(spark):
    rows = [(i, f"text number {i // 2 if i < 8 else i}", ",".join(["a"] if i % 3 else ["a", "b"]), "x" if i in (9, 12) else "") for i in range(40)]
    return spark.createDataFrame(rows, "rid int, text string, label string, generated_for string")


def test_holdout_split(spark):
    df = training(spark)
    made = split.holdout_split(df, "rid", ["text"], "label", 0.2)
    again = split.holdout_split(df, "rid", ["text"], "label", 0.2)
    train, held = ({r["rid"]: r for r in x.collect()} for x in (made.train, made.holdout))
    assert set(train) | set(held) == set(range(40)) and not set(train) & set(held)
    assert not {r["text"] for r in train.values()} & {r["text"] for r in held.values()}
    assert not any(r["generated_for"] for r in held.values())
    assert {x for r in held.values() for x in r["label"].split(",")} == {"a", "b"}
    assert set(held) == {r["rid"] for r in again.holdout.collect()}
    assert made.stats.first()["holdout_rows"] == len(held)


def test_preflight(spark):
    rows = [(0, "tiny", ""), (1, "abc", "a"), (2, "a good text", "a"), (3, "A GOOD text", "a"), (4, "another one", "a,b/"), (5, "third text", "b"), (6, "fourth text", "b")]
    df = spark.createDataFrame(rows, "rid int, t string, l string")
    fates = labels.preflight_rows(df, "rid", ["t"], "l")
    assert {r["row"]: r["fate"] for r in fates.collect()} == {0: "no_label", 1: "too_short", 2: "kept", 3: "duplicate", 4: "kept", 5: "kept", 6: "kept"}
    total, each = labels.preflight(fates, 2)
    assert total.first()["effective_rows"] == 4
    assert {r["label"]: r["state"] for r in each.collect()} == {"a": "learnable", "b": "learnable"}


def test_label_filter_and_cap(spark):
    rows = [(0, "s/a,t/b", "A,B"), (1, "s/a", "A name, with comma"), (2, "t/b", "B"), (3, "s/a,t/c", "only one")]
    df = spark.createDataFrame(rows, "rid int, l string, l_DISPLAYNAME string")
    out = labels.label_filter(df, "l", "s/")
    assert [(r["rid"], r["l"], r["l_DISPLAYNAME"]) for r in out.df.orderBy("rid").collect()] == [(0, "s/a", "A"), (1, "s/a", "A name, with comma"), (3, "s/a", "")]
    assert out.stats.first().asDict() == {"before": 4, "after": 3, "removed": 1, "changed": 2}
    with pytest.raises(ValueError):
        labels.label_filter(df, "l", "")
    many = spark.createDataFrame([(i, "A") for i in range(5)] + [(5, "B"), (6, "A,B"), (7, "")], "rid int, l string")
    assert sorted(r["rid"] for r in labels.cap_per_label(many, "rid", "l", 2).collect()) == [0, 1, 5, 6]
    with pytest.raises(ValueError):
        labels.cap_per_label(many, "rid", "l", 0)


def test_combine(spark):
    a = spark.createDataFrame([(0, "one", "x"), (1, "two", "y")], "rid int, t string, l string")
    b = spark.createDataFrame([(0, "two", "m"), (1, "three", "")], "rid int, body string, generated_for string")
    made = combine.combine([combine.Source(a, {"text": "t", "label": "l"}, "A", "rid"), combine.Source(b, {"text": "body", "label": None}, "B", "rid")], ["text", "label"], ["text"])
    rows = {(r["text"], r["label"], r["source"], r["generated_for"]) for r in made.df.collect()}
    assert rows == {("one", "x", "A", ""), ("two", "y", "A", ""), ("three", "", "B", "")}
    assert {r["source"]: (r["rows_in"], r["rows_kept"]) for r in made.stats.collect()} == {"A": (2, 2), "B": (2, 1)}
    with pytest.raises(ValueError):
        combine.combine([combine.Source(a, {}, "A", "rid")], ["text"], [])
    assert combine.suggest_mapping(["p.title", "description", "kw"], ["title", "general_description", "x"]) == {"title": "p.title", "general_description": "description", "x": None}


def test_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(50)] + [(50, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    unit = []
    for _, v in df.collect():
        n = sum(x * x for x in v) ** 0.5
        unit.append([x / n for x in v] if n else v)
    cos = lambda i, j: sum(a * b for a, b in zip(unit[i], unit[j], strict=True))
    want = {(i, j) for i in range(51) for j in range(i + 1, 51) if cos(i, j) >= 0.6}
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(df, "id", "v", 0.6, blocks=3).collect()} == want
    found = {(r["a"], r["b"]) for r in vectors.banded_pairs(df, "id", "v", 6, 0.6).collect()}
    assert found <= want and len(found) >= 0.8 * len(want)
    kept = []
    for i in range(51):
        if all(cos(j, i) < 0.6 for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in vectors.dedupe_semantic(df, "id", "v", 0.6).collect()) == kept
    left = vectors.leakage_gate(df.where("id < 25"), "id", "v", df.where("id >= 25"), "v", 0.6)
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(25) if all(cos(i, j) < 0.6 for j in range(25, 51))]


def test_banded_pairs_are_whole(spark):
    rng = np.random.default_rng(5)
    # 120 vectors at random, 60 close to one direction and 60 to its opposite: hot codes, and blocks that a bound excludes.
    hot = rng.standard_normal(16)
    near = [s * hot + 0.05 * rng.standard_normal(16) for s in (1, -1) for _ in range(60)]
    values = [*rng.standard_normal((120, 16)), *near, np.zeros(16)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)] + [(1000, None), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    x = np.array(values, dtype=np.float32).astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cos = unit @ unit.T
    for threshold in (0.4, 0.9):
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= threshold}
        found = [(r["a"], r["b"]) for r in vectors.banded_pairs(df, "id", "v", 16, threshold, blocks=8).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert vectors.banded_pairs(df.where("id < 0"), "id", "v", 16, 0.4).count() == 0


@pytest.mark.parametrize("group", [1, 2, 100])
def test_near_blocks_keeps_what_may_meet(spark, group):
    centers = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]

    def near(radii, threshold):
        balls = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(zip(centers, radii, strict=True))], "block int, center array<double>, radius double")
        return sorted(tuple(r) for r in vectors.near_blocks(balls, threshold, group).collect())

    assert near([0.1] * 3, 0.9) == [(0, 0), (1, 1), (2, 2)]
    assert near([0.6, 0.6, 0.1], 0.9) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert len(near([np.pi / 2] * 3, 0.9)) == 6 and vectors.near_blocks(spark.createDataFrame([], "block int, center array<double>, radius double"), 0.9).count() == 0


def test_vocabulary(spark):
    rows = [("a", "A", None, 0), ("b", "B", "a", 1), ("c", "C", "a", 0), ("d", "D", "b", 0), ("x", "X", "y", 0), ("y", "Y", "x", 0)]
    walked = vocab.tree(spark.createDataFrame(rows, "uri string, label string, broader string, ord int"), "Top")
    got = [(r["uri"], r["depth"], r["anchor"]) for r in walked.orderBy("position").collect()]
    assert got == [("a", 0, "Top → A"), ("c", 1, "Top → A → C"), ("b", 1, "Top → A → B"), ("d", 2, "Top → A → B → D")]
    assert {r["uri"] for r in vocab.select_concepts(walked, "subtree", "b").collect()} == {"b", "d"}
    for bad in (("subtree", "zz", None), ("list", None, ["zz"]), ("other", None, None)):
        with pytest.raises(ValueError):
            vocab.select_concepts(walked, *bad)
    lines = spark.createDataFrame([(0, "Früh Jahr"), (1, "frueh!"), (2, "Früh-Jahr"), (3, "https://v.org/1 Name"), (4, "")], "ord int, line string")
    slugs = [r["uri"] for r in vocab.slugs(lines, "https://e.org").orderBy("ord").collect()]
    assert slugs == ["https://e.org/fruh-jahr", "https://e.org/frueh", "https://e.org/fruh-jahr-2", "https://v.org/1"]


def _random_vectors(spark, n, seed):
    x = np.random.default_rng(seed).standard_normal((n, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "id long, v array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    return rows, x


def test_products_with_a_reference_take_bounded_memory():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((1500, 4)), rng.standard_normal((30_000, 4))
    tracemalloc.start()
    best = vectors._best(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and np.allclose(best[:50], np.maximum((x[:50] @ y.T).max(axis=1), 0))


def test_a_large_reference_is_compared_by_few_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SENT", 100)
    monkeypatch.setattr(vectors, "GRID", 8 * 100)
    rows, x = _random_vectors(spark, 450, 5)
    found = {r["id"]: r["similarity"] for r in vectors.best_match(rows, "id", "v", rows.where("id % 3 = 0"), "v").collect()}
    assert np.allclose([found[i] for i in range(450)], np.maximum((x @ x[::3].T).max(axis=1), 0))


def test_semantic_duplicates_by_stretches(spark, monkeypatch):
    """Whatever the stretch, the result is that of the pass; links of rows that an earlier stretch drops are never made."""
    rows, x = _random_vectors(spark, 600, 6)
    near, kept = x @ x.T >= 0.6, []
    for i in range(600):
        if not near[i, kept].any():
            kept.append(i)
    made, pairs = [], vectors.similar_pairs

    def counted(*args):
        found = pairs(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(vectors, "similar_pairs", counted)
    both = rows.unionByName(spark.createDataFrame([(600, None)], "id long, v array<double>"))
    for batch in (40, 250, 5000):
        made.clear()
        assert sorted(r["id"] for r in vectors.dedupe_semantic(both, "id", "v", 0.6, batch=batch).collect()) == [*kept, 600]
        if batch == 40:
            assert len(made) > 1 and sum(made) < np.triu(near, 1).sum() / 5


def test_keys_are_worked_out_once(spark):
    """Each row's key is made once, whatever is joined to it afterwards."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(text):
        made.add(1)
        return text.lower()

    df = spark.createDataFrame([(i, "aAbBc"[i % 5]) for i in range(50)], "doc_id long, text string")
    found = {r["doc_id"]: r["first"] for r in labels.first_of_key(df, "doc_id", key("text")).collect()}
    assert found == {i: [0, 0, 2, 2, 4][i % 5] for i in range(50)} and made.value == 50
