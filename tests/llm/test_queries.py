"""The registered queries against their contracts on the smallest tables: brute force, the library, held-out labels."""

import hashlib
import re
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zlib

from rowforge.llm import mixing, queries
from tests.conftest import DATA
from tests.llm.test_models import brute
from tests.llm.test_text_operators import closed, fingerprint, windows_removed

TYPES = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def of(name):
        if name not in made:
            df = queries.queries()[name](spark, DATA)
            kinds = dict(df.dtypes)
            wanted = dict(c.split() for c in TYPES[name].split(", "))
            assert {c: kinds.get(c) for c in wanted} == wanted
            made[name] = df.collect()
        return made[name]

    return of


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(docs, result):
    import base64

    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = result("op1_byte_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha(text.encode()))


def test_op2(docs, result):
    rows, homes, size = result("op2_sharding"), {}, Counter()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text)) and 0 <= r["shard"] < 8
        homes.setdefault(text, set()).add(r["shard"])
        size[r["shard"]] += r["size"]
    mean, largest = sum(size.values()) / 8, max(r["size"] for r in rows)
    assert all(abs(size[s] - mean) <= max(0.03 * mean, 2 * largest) for s in range(8))
    assert sum(len(h) > 1 for h in homes.values()) <= 7
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_op3(docs, result):
    rows, sums = result("op3_mixing"), {}
    for r in rows:
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        s = sums.setdefault(docs[r["doc_id"]]["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sums[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(v[0] for v in sums.values()), 2.0)
    for name, target in zip(names, want, strict=True):
        size, taken, told, goal = sums[name]
        assert size == told and abs(goal - target) < 1e-6 and abs(taken - target) <= 0.5 + 1e-6


def test_op4(spark, docs, result):
    rows = result("op4_quality_classifier")
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_queries_equal_their_statements(result):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = con.sql(sql)
        rows = result(name)
        assert Counter(found.fetchall()) == Counter(tuple(r[c] for c in found.columns) for r in rows)


def test_op6(docs, result):
    rows = {r["doc_id"]: r for r in result("op6_substring_dedup")}
    words = [(r["text"] or "").encode().split() for r in docs.values()]
    for doc_id, w, kept in zip(docs, words, windows_removed(words), strict=True):
        assert tuple(rows[doc_id])[1:4] == (len(w), len(w) - len(kept), sha(b" ".join(kept)))


def test_op7(docs, result):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in result("op7_quality_rules"):
        want = brute(docs[r["doc_id"]]["text"])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op8(spark, result):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    good = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])}
    found = {}
    for r in result("op8_ann"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    asked, recall = [i for i in ids if i % 20 == 0], []
    assert set(found) == set(asked)
    for q in asked:
        got = sorted(found[q])
        near = x @ good[q]
        assert [g[0] for g in got] == list(range(1, min(20, len(ids) - 1) + 1)) and np.allclose([good[g[1]] @ good[q] for g in got], [g[2] for g in got], rtol=1e-12)
        near[ids == q] = -np.inf
        recall.append(len(set(ids[np.argsort(-near, kind="stable")[:20]]) & {g[1] for g in got}) / 20)
    assert np.mean(recall) >= 0.9


def article(page):
    """The article element's text, by regular expressions: inline tags go, every block tag ends a line."""
    inside = re.search(r"<article\b[^>]*>(.*?)</article\s*>", re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", page), re.S | re.I).group(1)
    inside = re.sub(r"(?i)<br\s*/?>", " ", inside)
    lines = re.split(r"(?i)</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|table|tr|td|pre|figure|figcaption|hr)\b[^>]*>", inside)
    shown = (re.sub(r"\s+", " ", unescape(re.sub(r"<[A-Za-z/!][^>]*>", "", line))).strip() for line in lines)
    return "\n".join(line for line in shown if line)


def test_op9(spark, result):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = result("op9_html_extraction")
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows)
    hit = 0
    for r in rows:  # the given pages mark their article by its tag
        hit += article(pages[r["page_id"]]["html"]) == r["text"]
        assert not re.search(r"\s{2,}|<script", r["text"].replace("\n", " | "))
    assert hit / len(rows) >= 0.98


def test_op11_columns(docs, result):
    assert {r["doc_id"] for r in result("op11_periodic_runs")} == set(docs)


def test_op10(docs, result):
    ids = list(docs)
    fps = [fingerprint(docs[i]["text"]) for i in ids]
    group = closed([(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(ids)))
    least = {}
    for i, d in enumerate(ids):
        least[group[i]] = min(least.get(group[i], d), d)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op10_simhash")} == {d: (f"{fps[i]:016x}", least[group[i]]) for i, d in enumerate(ids)}
