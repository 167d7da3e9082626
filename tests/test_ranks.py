"""Percentiles by ranks, common values by sketches, and contrast lists, against plain ways."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators import labels, profile, ranks

SHARES = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.951, "f": 1.0}


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_percentiles_equal_the_plain_ones(spark, partitions):
    rng = random.Random(int(partitions))
    values = {g: [rng.choice([rng.randrange(9), rng.uniform(-5, 5), -0.0]) for _ in range(n)] for g, n in (("one", 1), ("two", 2), ("many", 900), ("hot", 300))}
    values["hot"] += [7.25] * 500
    rows = [(g, float(v), 1) for g, own in values.items() for v in own] + [("none", None, 3), ("many", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n int").groupBy("g", "x").agg(F.sum("n").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["g"]: [r[c] for c in SHARES] for r in ranks.percentiles(df, ["g"], SHARES).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert set(got) == set(values)
    for g, own in values.items():
        assert np.allclose(got[g], [np.quantile(own, p) for p in SHARES.values()], atol=1e-12)
    assert ranks.percentiles(df.limit(0), ["g"], SHARES).count() == 0


def test_a_column_has_many_ranges(spark, monkeypatch):
    """Where partitions are not merged for being small, no range of a column of 20,000 values has half of them."""
    df = spark.range(20_000).select(F.lit("c").alias("column"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    dealt = []
    monkeypatch.setattr(ranks, "settle", lambda d, plain=ranks.settle: dealt.append(plain(d)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranks.percentiles(df, ["column"], {"m": 0.5}).first()["m"] == 9999.5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in dealt[0].groupBy("range").count().collect()) < 10_000


def test_numeric_summary_of_many_values(spark):
    df = spark.range(5_000).select((F.col("id") * 3).alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")).alias("b"), F.lit("").alias("c"))
    got = profile.numeric_summary(df).collect()
    assert [(r["column"], r["parsed"], r["median"], r["p05"], r["p95"]) for r in got] == [("a", 5000, 7498.5, 749.85, 14247.15)]
    near = profile.numeric_summary(df, approx=True).first()
    assert abs(near["median"] - 7498.5) < 10


def test_top_values_on_both_sides_of_the_sketch(spark, monkeypatch):
    """Common values are told by the sketch, columns without any are counted in full; the answer is the same."""
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), str(rng.randrange(4_000)), rng.choice(["", None, " x ", "y"]), "same") for _ in range(6_000)]
    df = spark.createDataFrame(rows, "few string, many string, gaps string, one string")
    want = []
    for i, c in enumerate(df.columns):
        counts = Counter(r[i].strip() for r in rows if r[i] and r[i].strip())
        want += [(c, k, v, n) for k, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3], 1)]
    shuffled = []
    monkeypatch.setattr(profile, "value_counts", lambda d, plain=profile.value_counts: shuffled.append(d.columns) or plain(d))
    for tracked in (10**9, 1_000):
        monkeypatch.setattr(profile, "TRACKED", tracked)
        monkeypatch.setattr(profile, "SKETCH_ERROR", 7 / 1_000)
        monkeypatch.setattr(profile, "MOST", 500)
        assert sorted(tuple(r) for r in profile.top_values(df, 3).collect()) == sorted(want)
    assert shuffled == [df.columns, ["many", "gaps", "one"]]
    assert profile.top_values(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_contrast_lists(spark, cap):
    rng = random.Random(cap)
    rows = {(i, f"l{rng.randrange(12) if rng.random() < 0.6 else 20 + rng.randrange(30)}") for i in range(150) for _ in range(rng.randint(1, 3))}
    each = spark.createDataFrame(sorted(rows), "row int, label string")
    shown = {f"l{i}": f"name {i // 2}" for i in range(0, 60, 3)}
    names = spark.createDataFrame(sorted(shown.items()), "label string, name string")
    support = Counter(label for _, label in rows)
    by_row = {}
    for row, label in rows:
        by_row.setdefault(row, []).append(label)
    want = {}
    for label in support:
        shared = Counter(o for own in by_row.values() if label in own for o in own if o != label)
        listed = []
        for other in sorted((o for o in support if o != label), key=lambda o: (-shared[o], -support[o], o)):
            name = shown.get(other, other)
            if name not in listed and name != shown.get(label, label):
                listed.append(name)
        want[label] = (listed[:cap], max(0, len(listed) - cap))
    got = {}
    for r in labels.contrast_labels(each, names, cap, with_rest=True).orderBy("label", "rank").collect():
        got.setdefault(r["label"], ([], r["more"]))[0].append(r["other"])
    assert got == want
