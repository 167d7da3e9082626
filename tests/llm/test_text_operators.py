import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from rowforge.llm import bpe, mixing, sharding, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or give to results.
CLASH = {"size": 1, "Shard": 2, "slot": 3, "fp": 4, "kept": 5, "ids": 6, "score": 7, "taken": 8, "n_words": 9, "component_id": 10}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 7 == 0:
            text = f"{text} {passage}\n{word()}"
        if i % 11 == 0 and rows:
            text = rows[-1][1]
        if i % 13 == 0 and rows:
            text = (rows[-1][1] or "") + " x"
        rows.append((i, text, "en", f"s{i % 3}", 0))
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, " \t\n", "en", "s1", 3), (103, "one two", "en", "s1", 7), (103, "one two", "en", "s1", 7), (None, "no id here", "en", None, 1)]
    rows.append((104, "long " * 20_000 + passage, "en", "s2", 5))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  \n\n x\t\ty  ", "it's we'll I'M 's", "a" * 3000, "\x1c a\x1fb \x85   　z", "<|endoftext|>", "😀👩‍👧 naïve ﷽", "1234567890" * 30, "日本語" * 99, "  a ​b", "ab" * 500, "x\x00y"]


def test_segments_that_polynomial_hashes_confuse(spark, vocabulary):
    """A Thue-Morse word and its complement, in one text and across texts, have their own ids."""
    one, two = ("xyz" + "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(256)) + "xyz" for k in (0, 1))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(vocabulary.pieces) if p}, special_tokens={})
    df = spark.createDataFrame([(0, f"{one} {two}"), (1, one), (2, two), (3, f"{two} {one} {two}")], "doc_id long, text string").coalesce(1)
    for r in bpe.encode(df.select("doc_id", "text", df.text.alias("own")), vocabulary, decoded=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["own"]) and bytes(r["decoded"]).decode() == r["own"]


def test_bpe_equals_the_library(vocabulary, reference):
    codec, rng = bpe.Codec(vocabulary), random.Random(2)
    texts = ODD + ["".join(rng.choice("ab \n.é'1") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    ids = codec.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert codec.encode(texts) == ids  # from what it has kept
    assert [x.decode() for x in codec.decode(ids)] == texts


def test_bpe_long_words_of_any_make(vocabulary, reference, monkeypatch):
    """Words over 64 bytes of random letters, syllables, few letters and repeated pieces, in one query and in several."""
    codec, rng = bpe.Codec(vocabulary), random.Random(41)
    syllables = ["the", "ing", "er", "on", "qu", "str", "un", "x", "tion", "re"]
    words = []
    for i in range(60):
        n = rng.randint(65, 900)
        letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeiou", "etaoin", "äöüßabc"][i % 5]
        words.append("".join(rng.choice(letters) for _ in range(n)))
        words.append("".join(rng.choice(syllables) for _ in range(n // 3)))
        words.append("".join(rng.choice(letters) * rng.randint(1, 40) for _ in range(n // 20)))
    want = [reference.encode_ordinary(w) for w in words]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(words)] == want
    monkeypatch.setattr(bpe, "BATCH_ROWS", 3000)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.Codec(vocabulary).encode(words[:30])] == want[:30]


def test_bpe_very_long_word(vocabulary, reference):
    rng = random.Random(42)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert np.frombuffer(bpe.Codec(vocabulary).encode([word])[0], dtype="<u4").tolist() == reference.encode_ordinary(word)


def test_bpe_small_cache(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_SEGMENTS", 5)
    monkeypatch.setattr(bpe, "CHUNK", 64)
    texts = [f"word{i} and more{i % 3}" for i in range(40)]
    found = bpe.Codec(vocabulary).encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_tables(docs, clashing, empty, vocabulary, reference):
    rows = bpe.encode(clashing, vocabulary).collect()
    assert len(rows) == docs.count() and {"fp", "kept", "n_tokens", "ids"} <= set(rows[0].asDict())
    want = {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in docs.collect()}
    assert all(np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == want[r["doc_id"]] for r in rows)
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary), vocabulary).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in back)
    assert bpe.encode(empty, vocabulary).count() == 0
    lists = bpe.encode(docs.select("doc_id", "text"), vocabulary).where("doc_id = 103").select(bpe.id_list().alias("x")).first()["x"]
    assert lists == want[103]


def windows_removed(texts, window=35):
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_substring_equals_brute_force(docs, clashing, window):
    rows = [r for r in docs.collect() if r["doc_id"] != 104] if window == 8 else docs.collect()
    given = clashing.where("doc_id is null or doc_id <> 104") if window == 8 else clashing
    texts = [(r["text"] or "").encode().split() for r in rows]
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), b" ".join(k).decode(), len(t), len(t) - len(k)) for r, t, k in zip(rows, texts, windows_removed(texts, window), strict=True))
    got = substring.remove_repeats(given, window)
    assert "slot" in got.columns and "text" not in got.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["kept"], r["n_words"], r["n_removed"]) for r in got.collect()) == want


def test_substring_periodic_and_empty(spark, empty):
    rows = [(1, "a b " * 40, "", "", 0), (2, "a b " * 40, "", "", 0), (3, " ".join(map(str, range(200))), "", "", 0), (4, " ".join(map(str, range(100, 160))), "", "", 0)]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 80, 2: 80, 3: 60, 4: 60}
    assert substring.remove_repeats(empty).count() == 0


def test_factors_are_extended_word_by_word():
    rng = random.Random(21)
    w = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    join = lambda *parts: " ".join(x for p in parts for x in p).encode()
    blocks = [
        join(w[:10], w[100:150], w[20:30]), join(w[30:40], w[100:140], w[40:60]), join(w[60:70], w[110:150], w[70:90]), join(w[150:200]),
        join(w[100:134]),
    ]
    found = substring.factors(blocks, [True, True, True, True, True], 35)
    # The first is copied from the second up to its end, and from the third behind it: two factors that cross.
    assert found == [(0, 10, 40), (0, 20, 40), (1, 10, 40), (2, 10, 40)]
    assert substring.factors(blocks, [False, True, False, False, False], 35) == [(1, 10, 40)]
    assert substring.joined(np.array([10, 16]), np.array([6, 11]), 35) == [(10, 61)]  # windows follow on
    assert substring.joined(np.array([17, 10]), np.array([11, 6]), 35) == [(10, 50), (17, 62)]


def test_factors_equal_brute_force():
    rng = random.Random(22)
    for _ in range(60):
        blocks = [[rng.choice("ab") for _ in range(rng.randint(4, 9))] for _ in range(rng.randint(1, 7))]
        # as blocks are cut, no window stands twice in one of them
        blocks = [b for b in blocks if len({tuple(b[i : i + 4]) for i in range(len(b) - 3)}) == len(b) - 3]
        gone = [np.zeros(len(b), dtype=bool) for b in blocks]
        for block, at, size in substring.factors([" ".join(b).encode() for b in blocks], [True] * len(blocks), 4):
            gone[block][at : at + size] = True
        assert [[x for x, g in zip(b, m, strict=True) if not g] for b, m in zip(blocks, gone, strict=True)] == windows_removed(blocks, 4)


def test_substring_overfull_anchors_and_long_factors(spark, monkeypatch):
    """A passage of many blocks in many texts: with GROUP = 2 its ends are looked up window by window."""
    rng = random.Random(23)
    new = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = new(150)
    texts = [f"{new(40)} {passage} {new(40)}" for _ in range(30)] + [f"{passage} {new(3)}", new(200)] + [new(60)] * 20
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    want = sorted(b" ".join(k).decode() for k in windows_removed([t.encode().split() for t in texts]))
    for group in (2048, 2):
        monkeypatch.setattr(substring, "GROUP", group)
        assert sorted(r["kept"] for r in substring.remove_repeats(df).collect()) == want


def test_substring_of_short_texts_only(spark):
    """Texts that have a window's words only together have no blocks."""
    df = spark.createDataFrame([(i, f"short text {i} " * 4) for i in range(40)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(df).collect()} == {0}


def test_substring_same_id_and_crc(spark):
    """Rows without an id whose texts differ are different texts."""
    texts = [f"{i} " + " ".join(f"v{(i * 7 + k) % 900}" for k in range(60)) for i in range(400)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    want = sorted(b" ".join(k).decode() for k in windows_removed([t.encode().split() for t in texts]))
    assert sorted(r["kept"] for r in substring.remove_repeats(df).collect()) == want


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_keep_one_of_near_copies_without_ids(spark):
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 400, 40)]
    fps = [fingerprint(t) for t in texts]
    group = closed([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(fps)))
    assert len(set(group.values())) < len(set(fps))
    kept = simhash.keep_one(spark.createDataFrame([(None, t, "en", "s", 0) for t in texts], SCHEMA)).collect()
    assert sorted(group[texts.index(r["text"])] for r in kept) == sorted(set(group.values()))


def test_simhash_equals_brute_force(docs, clashing, empty):
    rows = clashing.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    group = closed(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[group[i]] = min(least.get(group[i], 1 << 60), r["doc_id"])
    want = Counter((r["doc_id"], f"{fps[i]:016x}", least.get(group[i])) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(clashing).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(group.values())) and simhash.keep_one(empty).count() == 0
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {v for v in least.values()}


def test_simhash_divides_full_buckets(spark):
    """A dense cluster and a chain; tiny buckets force every level of division."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    chain = rng.getrandbits(64)
    for step in range(40):
        chain ^= 7 << (step % 20) * 3
        fps.add(chain)
    fps = sorted(fps)
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    want = closed(links, fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.components(simhash.links(table, largest=4)).collect()
    got = {x: signed(x) for x in fps}
    got.update({r["node"] % (1 << 64): r["root"] for r in found})
    same = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert same(got) == same(want)


def test_sharding(docs, clashing, empty, spark):
    rows = sharding.assign(clashing, 4).collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    again = sharding.assign(docs, 4).collect()
    key = lambda rs: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rs)
    assert key(rows) == key(again)
    assert sharding.assign(empty, 4).count() == 0
    rng = random.Random(3)
    many = [(i, "hot copy of a text" if i % 3 == 0 else f"text {i} " * rng.randint(1, 9), "", "", 0) for i in range(6000)]
    placed = sharding.assign(spark.createDataFrame(many, SCHEMA), 8).collect()
    bytes_of = Counter()
    for r in placed:
        bytes_of[r["shard"]] += r["size"]
    mean = sum(bytes_of.values()) / 8
    assert len(bytes_of) == 8 and all(abs(b / mean - 1) < 0.05 for b in bytes_of.values())
    homes = {}
    for r in placed:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) == 1  # only the text that is a third of all


def test_sharding_divides_rows_repeated_whole(spark, monkeypatch):
    rows = [(None, "the same text and id", "", "", 0)] * 3000 + [(i, f"text {i} " * 9, "", "", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    placed = sharding.assign(df, 8).collect()
    size = Counter()
    for r in placed:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert len(placed) == 4500 and all(abs(size[s] / mean - 1) < 0.05 for s in range(8))
    for shard in range(8):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)  # the number of rows divides a piece too
    again = sharding.assign(df, 2).collect()
    assert len(again) == 4500 and sorted(r["slot"] for r in again if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in again)))


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def test_mixing_targets_and_tree():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == [20, 25 / 3, 50 / 3]
    assert mixing.targets([0, 4], [3, 1], 6, 2) == [0, 6]
    assert mixing.targets([], [], 0, 2) == []
    split = mixing.split_tree([7, 0, 31], mixing.fair(38, 5), seed=1)
    assert split.sum(axis=1).tolist() == mixing.fair(38, 5)
    assert split.sum(axis=0).tolist() == [7, 0, 31] and (split >= 0).all() and split.shape == (5, 3)
    assert (split == mixing.split_tree([7, 0, 31], mixing.fair(38, 5), seed=1)).all()


def test_mixing(docs, clashing, empty, monkeypatch):
    for block in (2048, 4):
        monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
        rows = mixing.plan(clashing).collect()
        size = {}
        for r in rows:
            s = size.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
            s[0] += r["size"]
            s[3] += r["taken"]
            assert r["taken"] <= 2 * r["size"] and len(r["shard_of_copy"]) == r["copies"]
        assert len(rows) == docs.count()
        for source, (words, told, target, taken) in size.items():
            assert words == told and taken <= target + 1, source
        assert abs(sum(s[2] for s in size.values()) - 1.5 * sum(s[0] for s in size.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert sorted(mixed.columns) == sorted([*docs.columns, "mix_shard", "mix_order"])
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    key = lambda d: Counter((r["doc_id"], r["text"], r["copies"], tuple(r["shard_of_copy"])) for r in d.collect())
    assert key(mixing.plan(docs)) == key(mixing.plan(docs.repartition(5)))


def taken_by_source(rows):
    out = {}
    for r in rows:
        s = out.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    return out


def test_mixing_meets_every_target(spark, monkeypatch):
    rng = random.Random(31)
    words = lambda n: " ".join("ab" for _ in range(n))
    one_each = [(i, words(100), "en", f"s{i}", 0) for i in range(6)]
    equal = [(7, words(9), "en", "same", 0)] * 500 + [(None, words(4), "en", None, 0)] * 300 + [(8, None, "en", "none", 0)] * 5
    mixed = [(i, words(rng.randint(0, 60)), "en", f"m{i % 3}", 0) for i in range(400)]
    for rows in (one_each, one_each + equal + mixed):
        for listed, kinds, block in ((10_000, 4096, 2048), (0, 3, 16)):
            monkeypatch.setattr(mixing, "LISTED", listed)
            monkeypatch.setattr(mixing, "TREE_KINDS", kinds)
            monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
            df = spark.createDataFrame(rows, SCHEMA).repartition(4)
            found = mixing.plan(df).collect()
            got = taken_by_source(found)
            names = sorted(got, key=lambda s: (s is None, s or ""))
            want = mixing.targets([got[s][0] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(g[0] for g in got.values()), 2.0)
            for s, target in zip(names, want, strict=True):
                assert abs(got[s][2] - target) < 1e-6 and abs(got[s][1] - target) <= 0.5 + 1e-6, s
            assert len(found) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in found)
            for r in found:
                assert r["taken"] == r["size"] * (r["copies"] - (r["part"] is not None)) + (r["part"] or 0) and len(r["shard_of_copy"]) == r["copies"]
                assert all(0 <= x < 8 for x in r["shard_of_copy"])
            copies = mixing.mix(df, length="n_chars").collect()
            assert sum(len((r["text"] or "").split()) for r in copies) == sum(r["taken"] for r in found)


def test_first_words(spark):
    rows = [(" a\tb\n\nc  d\n", 2, " a\tb"), ("x y", 2, "x y"), ("x", 1, "x"), ("word " * 3000, 2500, ("word " * 2500).strip())]
    df = spark.createDataFrame(rows, "t string, n int, want string")
    from pyspark.sql import functions as F

    assert [r["x"] for r in df.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()] == [r[2] for r in rows]


def test_digest_of_kept_text_is_native(docs):
    from pyspark.sql import functions as F

    row = substring.remove_repeats(docs).where("doc_id = 103").select("kept", F.sha2("kept", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(row["kept"].encode()).hexdigest()
