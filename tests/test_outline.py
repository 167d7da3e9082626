"""Depth, size and place of concepts against a plain walk."""

import random

import pytest

from rowforge.operators import outline


def walked(rows):
    first = {}
    for uri, broader, ord_ in rows:
        key = (ord_, "" if broader is None else ">" + broader)
        if uri not in first or key < first[uri][0]:
            first[uri] = (key, broader)
    below = {}
    for uri, ((ord_, _), broader) in first.items():
        below.setdefault(broader, []).append((ord_, uri))
    out, order, todo = {}, [], [(u, 0) for _, u in sorted(below.get(None, []), reverse=True)]
    while todo:
        uri, depth = todo.pop()
        out[uri] = [depth, 1, len(order)]
        order.append(uri)
        todo += [(u, depth + 1) for _, u in sorted(below.get(uri, []), reverse=True)]
    for uri in reversed(order):
        up = first[uri][1]
        if up is not None:
            out[up][1] += out[uri][1]
    return {u: tuple(v) for u, v in out.items()}


def shown(df):
    return {r["uri"]: (r["depth"], r["size"], r["place"]) for r in outline.outline(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_forests(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{i}", None if i < 3 else f"c{rng.randrange(max(1, i - 6) if seed else 1, i)}" if rng.random() < 0.95 else "nowhere", rng.randrange(4)) for i in range(70)]
    rows += [("x", "y", 0), ("y", "x", 0), ("z", "y", 1), ("self", "self", 0), ("c5", "c4", 9), ("c5", "c4", 9)]
    got = shown(spark.createDataFrame(rows, "uri string, broader string, ord long").repartition(3))
    assert got == walked(rows) and "x" not in got and "self" not in got


def test_a_hot_parent_in_many_ranges(spark):
    rows = [("top", None, 0)] + [(f"k{i:04d}", "top", i % 7) for i in range(900)] + [(f"s{i}", f"k{i:04d}", 0) for i in range(0, 900, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert shown(spark.createDataFrame(rows, "uri string, broader string, ord long")) == walked(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_deep_path_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5_000, []
    monkeypatch.setattr(outline, "settle", lambda df, plain=outline.settle: rounds.append(1) or plain(df))
    rows = spark.range(n).selectExpr("concat('c', id) AS uri", "CASE WHEN id > 0 THEN concat('c', id - 1) END AS broader", "0L AS ord")
    got = shown(rows)
    assert got == {f"c{i}": (i, n - i, i) for i in range(n)} and len(rounds) <= 3 + 14


def test_empty(spark):
    assert outline.outline(spark.createDataFrame([], "uri string, broader string, ord long")).count() == 0


def test_leaves_take_no_rounds(spark, monkeypatch):
    """A flat vocabulary of many concepts is ranked in the rounds that its few inner concepts need."""
    rounds = []
    monkeypatch.setattr(outline, "settle", lambda df, plain=outline.settle: rounds.append(1) or plain(df))
    rows = [("a", None, 0), ("b", None, 1), ("m", "a", 500)] + [(f"k{i:04d}", "abm"[i % 3], i % 700) for i in range(3000)]
    assert shown(spark.createDataFrame(rows, "uri string, broader string, ord long")) == walked(rows) and len(rounds) <= 9
