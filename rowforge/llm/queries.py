"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm import ann, audit, bpe, classifier, html, mixing, multi_index, periodic, rules, sharding, simhash, substring, url_filter
from rowforge.llm.common import WORD_PATTERN
from rowforge.session import read_table

#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary() -> bpe.Vocabulary:
    """The public vocabulary that the query and the pipeline encode with."""
    return bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the text decoded from them, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary(), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    placed = sharding.assign(docs.select("doc_id", "text", crc), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source weights 3, 1, 2 over 150 % of their words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs, share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken", "shard_of_copy")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every whole document, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    network = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, network)
    predicted = (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", classifier.held_out("doc_id").alias("held_out"), "score", predicted)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.remove_repeats(docs, window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, and the forest's verdict."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, rules.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.main_text(pages, html.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document of ten has a stretch of its words repeated up to its end.

    With h = crc32(doc_id as text) and g = h div 10, documents of h mod 10 = 0 keep their first a = g mod n words; from
    there on their next p words are repeated. A document without words or id is as it was.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("w")).select("*", F.size("w").alias("n"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every whole document, the longest one, and the text with each run left once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.collapse(with_planted_period(docs))
    found = found.withColumn("longest", F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))))
    length, start, period = (F.col(f"longest.{c}") * sign for c, sign in (("length", 1), ("col2", -1), ("col3", -1)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label, as counts and components."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return multi_index.near_duplicates(vectors, cosine=0.98, recall=1.0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters keep, remove and lose of each source, in every order."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit_texts(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP5_SQL = """
WITH rules(h, p, v) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'),
    ('example.net','/de/8','block'), ('org','/es/','block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fit AS (SELECT DISTINCT host, path, h || p AS rule, v FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fit GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


#: Every window as a string, those that stand twice or more, the words that they cover, and what is left.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
many AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN many USING (r)
"""


#: All vectors of a label compared; components by a recursive walk over the links, which are few.
OP12_SQL = """
WITH RECURSIVE good AS (
    SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
walk(r, peer) AS (SELECT r, r FROM good UNION SELECT walk.r, links.b FROM walk JOIN links ON links.a = walk.peer),
named AS (SELECT walk.r, min(good.vec_id) AS component_id FROM walk JOIN good ON good.r = walk.peer GROUP BY walk.r),
many AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM good JOIN named USING (r) LEFT JOIN many USING (r)
"""


#: Which filters each document fails, counted for each source, and every order of the filters over these counts.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_reduce([CASE WHEN fails[i] THEN 2 ** (i - 1) ELSE 0 END FOR i IN range(1, 6)], lambda x, y: x + y)::BIGINT AS cell,
    count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT i, chr(65 + i) AS c FROM (SELECT unnest(range(5))::INT AS i)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, k AS step, (1 << o[k])::BIGINT AS own, list_sum([1 << x FOR x IN o[1:k]])::BIGINT - (1 << o[k])::BIGINT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS k)),
s AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE cell & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE cell & own <> 0 AND cell & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE cell & own <> 0 AND cell & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE cell = own), 0) AS unique_fails,
    coalesce(sum(g) FILTER (WHERE cell & own <> 0 AND cell & before = 0), 0) AS good_lost, coalesce(sum(x) FILTER (WHERE cell & own <> 0 AND cell & before = 0), 0) AS toxic_lost
    FROM m, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""


def queries() -> dict:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_url_filters": op5_url_filters,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_ann": op8_ann,
        "op9_html_extraction": op9_html_extraction,
        "op10_simhash": op10_simhash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_embedding_near_dedup": op12_embedding_near_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op5_url_filters": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op12_embedding_near_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
