"""The pipeline's stages against plain Python on a small data folder."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_models import labelled, sentences
from tests.llm.test_text_operators import SCHEMA, closed, fingerprint, windows_removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("data")
    rows, marks = labelled(160)
    rng = random.Random(12)
    shared = sentences(rng, 12)
    docs = [(i, text, "en", f"s{i % 4}", len(text)) for i, text, _, _ in rows]
    docs += [(500 + i, docs[i + 1][1], "en", "s1", 1) for i in range(0, 20)]  # copies
    docs += [(600 + i, sentences(rng, 10) + " " + shared, "de", "s2", 1) for i in range(10)]  # a shared passage
    docs += [(700, None, None, None, None), (701, "", "", "", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(home / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(home / "labels.parquet"))
    return str(home)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {i for i, q, _ in labelled(160)[1] if q}
    first = corpus_pipeline.quality(spark, docs, folder).cache()
    ids = {r["doc_id"] for r in first.collect()}
    assert len(ids & good) / len(good) > 0.95 and len(ids & (set(range(160)) - good)) <= 2

    rows = first.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    group = closed([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(rows)))
    second = corpus_pipeline.near_dedup(spark, first, folder)
    want = {min(rows[j]["doc_id"] for j in group if group[j] == g) for g in set(group.values())}
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(want)

    rows = second.collect()
    kept = windows_removed([(r["text"] or "").encode().split() for r in rows])
    third = corpus_pipeline.substring_dedup(spark, second, folder)
    want = {r["doc_id"]: b" ".join(k).decode() for r, k in zip(rows, kept, strict=True) if k or not (r["text"] or "").split()}
    assert {r["doc_id"]: r["text"] for r in third.collect()} == want
    assert third.columns == corpus_pipeline.COLUMNS

    fourth = corpus_pipeline.mixed(spark, third, folder)
    assert fourth.columns == corpus_pipeline.COLUMNS
    words = lambda d: sum(len((r["text"] or "").split()) for r in d.collect())
    assert abs(words(fourth) / words(third) - 1.5) < 0.05


def test_substring_stage_keeps_what_is_written(spark):
    rng = random.Random(13)
    again = "\n".join(" ".join(f"r{rng.randrange(10**6)}" for _ in range(9)) for _ in range(5))
    clean = " Title\n\n  one\ttwo  three\n"
    docs = [
        (1, clean, "en", "s", 7), (2, None, "en", "s", None), (3, " \n", "en", "s", 2),
        (4, f" a\tb\n\n{again} c  d\n", "en", "s", 0), (5, f"e  f {again}\ng \t h", "en", "s", 0), (6, f"\t{again}\n i\n\nj ", "en", "s", 0),
        (7, f"k\n l {again} \n", "en", "s", 0), (8, again, "en", "s", 0),
    ]
    third = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(docs, SCHEMA), "")
    want = {1: (clean, 7), 2: ("", 0), 3: (" \n", 2), 4: (" a\tb\n\nc  d\n", 11), 5: ("e  f\ng \t h", 10), 6: ("\ti\n\nj ", 6), 7: ("k\n l \n", 6)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()} == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_what_comes(spark, folder, name):
    """Nulls in any column, empty and very long texts, ties, whole repeated rows, clashing names, an empty table."""
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(15)
    rows = [(i, sentences(rng, 6), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(None, None, None, None, None), (None, "", None, None, 0), (50, None, "en", None, None), (None, sentences(rng, 5), None, "s1", 1)]
    rows += [(60, sentences(rng, 4000), "de", "s2", 1)] + [(61, sentences(rng, 8), "de", "s2", 1)] * 3 + [(5, rows[5][1], "en", "s9", 1), (62, " \n\t", "en", "s1", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = docs.select("*", *[F.lit(1).alias(n) for n in ("size", "score", "ids", "_id", "t1", "own_0", "kept", "mix_shard")])
    last = name == corpus_pipeline.STAGES[-1][0]
    texts = [t or "" for _, t, *_ in rows]
    for given in (docs, extra):
        out = stage(spark, given, folder)
        assert set(out.columns) == ({"doc_id", "lang", "source", "n_tokens", "ids"} if last else set(corpus_pipeline.COLUMNS))
        found = out.collect()
        if name == "quality classifier":
            assert all((r["text"] or "") in texts for r in found)
        elif name == "SimHash near-dedup":
            fps = [fingerprint(t) for t in texts]
            group = closed([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(fps)))
            assert len(found) == len(set(group.values()))
        elif name == "substring dedup":
            kept = windows_removed([t.encode().split() for t in texts])
            assert len(found) == sum(bool(k) or not t.split() for k, t in zip(kept, texts, strict=True))
        elif name == "mixing":
            words = lambda ts: sum(len(t.split()) for t in ts)
            assert abs(words(r["text"] or "" for r in found) / words(texts) - 1.5) < 0.02
        else:
            assert len(found) == len(rows) and all(len(bytes(r["ids"])) == 4 * r["n_tokens"] for r in found)
        assert stage(spark, given.limit(0), folder).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"} and out.count() > 100
    assert len(corpus_pipeline.STAGES) == 5
