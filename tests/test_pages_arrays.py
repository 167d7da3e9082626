"""Deep pages by an index of ranges, and one JSON array over many part files."""

import json

import pytest
from pyspark.sql import functions as F

from rowforge.operators import review
from rowforge.sources import tables as src


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(0, 3000, 1, 5).select(F.when(n % 50 == 7, None).otherwise((n * 7919) % 1000).alias("o"), n.cast("string").alias("t"), F.when(n % 3 == 0, "Find me").otherwise("no").alias("s"))


@pytest.mark.parametrize("query", ["", "FIND"])
def test_every_page_by_the_index(rows, query):
    """Pages put together are the sorted rows; ties and missing order values are on each exactly once."""
    index = review.page_index(rows, "o", query, ["o", "s"], ranges=7)
    want = sorted((-1 if r["o"] is None else r["o"]) for r in rows.collect() if not query or r["s"] == "Find me")
    assert (index.total, index.matched) == (3000, len(want)) and 2 <= len(index.ranges) <= 9
    for offset in (0, 1, 59, 60, 61, 500, 999, len(want) - 3, len(want), 10_000):
        out = review.page(rows, "o", query, ["o", "s"], offset, 45, index)
        assert [(-1 if r["o"] is None else r["o"]) for r in out.df.collect()] == want[offset : offset + 45]
        assert tuple(out.stats.first()) == (3000, len(want))


def test_a_deep_page_sorts_its_own_range_only(rows, monkeypatch):
    monkeypatch.setattr(review, "DEEP", 100)
    monkeypatch.setattr(review, "RANGES", 10)
    near, far = (review.page(rows, "o", "", ["o"], offset, 5).df for offset in (99, 2500))
    want = sorted((-1 if r["o"] is None else r["o"]) for r in rows.collect())
    assert [r["o"] for r in far.collect()] == want[2500:2505] and [r["o"] for r in near.collect()] == want[99:104]
    index = review.page_index(rows, "o", "", ["o"], 10)
    sizes = [b - a for a, b in zip([r[2] for r in index.ranges], [r[2] for r in index.ranges[1:]] + [3000], strict=True)]
    assert max(sizes) < 900
    assert review.page_index(rows.limit(0), "o").ranges == [] and review.page(rows.limit(0), "o", offset=200).df.count() == 0


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 3), (57, 4)])
def test_part_files_are_one_array(spark, tmp_path, n, parts):
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit('a "q", [x]\n é'), "id")).alias("t")).repartition(parts)
    path = str(tmp_path / "a")
    src.write_json_array(df, path, "id")
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert json.loads(text) == [{"id": i, "t": None if i % 3 == 0 else f'a "q", [x]\n é{i}'} for i in range(n)]
    back = sorted(tuple(r) for r in src.read_json_array(spark, path, ["id", "t"]).collect())
    assert back == sorted((str(i), "" if i % 3 == 0 else f'a "q", [x]\n é{i}') for i in range(n))
    with pytest.raises(ValueError):
        src.write_json_array(df, path)
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_an_array_whose_first_tasks_have_no_rows(spark, tmp_path):
    df = spark.range(0, 400, 1, 8).where("id >= 330")
    src.write_json_array(df, str(tmp_path / "a"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert [r["id"] for r in json.loads(text)] == list(range(330, 400))
