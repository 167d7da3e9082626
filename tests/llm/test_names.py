"""Columns of any name go through every operator unchanged, but for those that a result column replaces."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from rowforge.llm import ann, bpe, classifier, html, mixing, periodic, rules, sharding, simhash, substring, url_filter
from tests.llm.test_models import RULES, labelled, page

NAMES = (
    "_id _text _doc _crc _value _mark _k _s _u _n id text_ s u1 u2 t1 t2 body spans k value who m1 m2 own_0 own_1 found at whole words n pid range part parts "
    "number base before hot fp root label first windows anchor key row block place expression prefix digest list code vector asks node"
).split()
RESULTS = "size shard slot source_size target copies taken shard_of_copy score anomaly kept n_words n_removed ids n_tokens decoded host path rule verdict fingerprint component_id".split()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, text, f"s{i % 3}") for i, text, _, _ in labelled(40)[0]] + [(100, None, None), (101, "", "s1"), (102, "same text", "s1"), (102, "same text", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in [*NAMES, *RESULTS]])


def encoded(df):
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.decode(bpe.encode(df, vocabulary), vocabulary)


def ranked(df):
    spark = df.sparkSession
    labels = spark.createDataFrame(labelled(40)[1], "doc_id long, quality int, toxic int")
    return df, labels


OPERATORS = {
    "bpe": (encoded, {"text", "ids", "n_tokens", "decoded"}),
    "sharding": (lambda df: sharding.assign(df, 3), {"size", "shard", "slot"}),
    "mixing": (mixing.plan, {"size", "source_size", "target", "copies", "taken", "part", "shard_of_copy"}),
    "mix": (mixing.mix, set()),
    "classifier": (lambda df: classifier.score(df, classifier.Network()), {"score"}),
    "url_filter": (lambda df: url_filter.judge(df, df.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"), url="text"), {"host", "path", "rule", "verdict"}),
    "substring": (substring.remove_repeats, {"text", "kept", "n_words", "n_removed"}),
    "substring as written": (lambda df: substring.remove_repeats(df, as_written=True), {"text", "kept", "n_words", "n_removed"}),
    "rules": (lambda df: rules.judge(df, rules.fit(*ranked(df))), {"text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"}),
    "html": (lambda df: html.main_text(df, html.train([page(__import__("random").Random(1))[0]], layouts=20), html="text"), {"text"}),
    "simhash": (simhash.keep_one, set()),
    "periodic": (periodic.collapse, {"text", "n_words", "runs", "collapsed"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_stay(table, name):
    work, replaced = OPERATORS[name]
    out = work(table)
    own = [c for c in [*NAMES, *RESULTS] if c not in replaced]
    assert set(own) | {"doc_id"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in own)
    if name not in ("mix", "simhash"):
        assert len(rows) == 44
    assert work(table.limit(0)).count() == 0 if name != "rules" else True


def test_vectors_of_clashing_tables(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i, i) for i in range(30)], "vec_id long, embedding array<float>, k1 long, ids long")
    assert ann.search(df, F.col("vec_id") == 0, k=3).count() == 3
    copies = df.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))
    assert [r["vec_id"] for r in ann.search(copies, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [1, 2, 3]
