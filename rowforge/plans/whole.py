"""Queries: operators over whole growing tables, stores and resumed streams, complete prompts and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowforge.functions import fields as fl
from rowforge.functions import text as tx
from rowforge.operators import balance, combine, generate, keys, labels, outline, registry, review, vectors, vocab
from rowforge.plans.catalog import register
from rowforge.plans.generation import _SHOWN, FIELDS, _entries, _shown, _targets
from rowforge.plans.labels import CLEAN, TREE, celled, concepts, documents
from rowforge.plans.streams import _events
from rowforge.plans.tables import _by_rules
from rowforge.session import read_table, shared_folder
from rowforge.sources import tables as src
from rowforge.streaming import intake

_by_rules("flt6_contains_some", "part", "p_partkey", [{"column": "p_type", "op": "contains", "value": "econ"}], "contains(lower(p_type), 'econ')")


@register("jn5_unmatched_some", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    pending = read_table(spark, d, "orders").where("o_orderstatus = 'P'")
    return keys.unmatched(read_table(spark, d, "customer"), pending, [("c_custkey", "o_custkey")]).select("c_custkey")


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    def _build(spark, d, how=_how):
        left = read_table(spark, d, "customer").select("c_custkey", "c_name")
        right = read_table(spark, d, "orders").select((F.col("o_custkey") + 700).alias("k"), "o_orderkey")
        return keys.join_tables(left, right, [("c_custkey", "k")], how, max_rows=None).df

    register(
        f"jn2_join_{_how}_whole",
        f"""SELECT coalesce(c_custkey, k)::VARCHAR AS c_custkey, coalesce(c_name, '') AS c_name, coalesce(o_orderkey::VARCHAR, '') AS o_orderkey
        FROM customer {_join} (SELECT o_custkey + 700 AS k, o_orderkey FROM orders) ON c_custkey = k""",
    )(_build)


@register("jn2_join_outer_heavy", """SELECT coalesce(l_orderkey::VARCHAR, '') AS l_orderkey, coalesce(l_linenumber::VARCHAR, '') AS l_linenumber, coalesce(l_linestatus, o_orderstatus) AS l_linestatus, coalesce(orders, '') AS orders
FROM lineitem FULL JOIN (SELECT o_orderstatus, count(*)::VARCHAR AS orders FROM orders GROUP BY 1) ON l_linestatus = o_orderstatus""")
def _(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    return keys.join_tables(lines, orders, [("l_linestatus", "o_orderstatus")], "outer", max_rows=None, piece_rows=5_000).df


@register("jn1_cardinality_whole", """WITH l AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
b AS (SELECT l.n AS ln, r.n AS rn FROM l FULL JOIN r ON l.k = r.k)
SELECT sum(ln)::BIGINT AS left_rows, sum(rn)::BIGINT AS right_rows, count(*) FILTER (WHERE ln IS NOT NULL AND rn IS NOT NULL) AS matching_keys, count(*) FILTER (WHERE rn IS NULL) AS left_only_keys,
coalesce(sum(ln * rn), 0)::BIGINT AS estimated_rows FROM b""")
def _(spark, d):
    found = keys.cardinality(read_table(spark, d, "customer"), read_table(spark, d, "supplier"), [("c_nationkey", "s_nationkey")])
    return found.select("left_rows", "right_rows", "matching_keys", "left_only_keys", "estimated_rows")


@register("flt13_page_documents", "SELECT doc_id, lang FROM documents WHERE contains(lower(lang), 'e') OR contains(lower(source), 'e') ORDER BY doc_id LIMIT 20 OFFSET 10")
def _(spark, d):
    return review.page(documents(spark, d), "doc_id", "e", ["doc_id", "lang", "source"], 10, 20).df.select("doc_id", "lang")


@register("flt13_deep_page", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'i') ORDER BY o_orderkey LIMIT 500 OFFSET 300")
def _(spark, d):
    orders = read_table(spark, d, "orders")
    index = review.page_index(orders, "o_orderkey", "I", ["o_orderkey", "o_orderpriority"], ranges=16)
    pages = [review.page(orders, "o_orderkey", "I", ["o_orderkey", "o_orderpriority"], offset, 250, index).df for offset in (300, 550)]
    return pages[0].unionByName(pages[1])


@register("agg8_display_names_documents", """SELECT source AS label, lang AS name FROM (SELECT source, lang, count(*) AS k, min(doc_id) AS f FROM documents WHERE lang <> '' AND source <> '' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC, f) = 1""")
def _(spark, d):
    df = documents(spark, d).select("doc_id", "source", F.col("lang").alias("source_DISPLAYNAME"))
    return labels.display_names(df, "doc_id", "source")


@register("agg10_contrast_rest", """WITH s AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1)
SELECT a.label, row_number() OVER (PARTITION BY a.label ORDER BY b.n DESC, b.label)::INT AS rank, b.label AS other, (SELECT count(*) FROM s) - 1 - 4 AS more FROM s a JOIN s b ON a.label <> b.label QUALIFY rank <= 4""")
def _(spark, d):
    return labels.contrast_labels(labels.edges(documents(spark, d), "doc_id", "source"), cap=4, with_rest=True)


def _fresh(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@register("src1_snk1_csv_documents", "SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, lang FROM documents")
def _(spark, d):
    path = _fresh(spark, "csv")
    src.write_table(documents(spark, d).select("doc_id", "text", "lang"), path, "csv")
    return src.read_csv(spark, path)


@register("src2_json_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def _(spark, d):
    path = _fresh(spark, "json")
    src.write_table(documents(spark, d).select("doc_id", "text", "lang"), path, "json")
    return src.read_json(spark, path)


@register("snk1_json_array", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def _(spark, d):
    path = _fresh(spark, "array")
    src.write_json_array(documents(spark, d).select("doc_id", "text", "lang"), path, "doc_id")
    return src.read_json_array(spark, path, ["doc_id", "text", "lang"])


@register("src6_tolerant_lines", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, 1::BIGINT AS skipped FROM orders")
def _(spark, d):
    path = _fresh(spark, "lines")
    src.write_table(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "jsonl")
    spark.createDataFrame([('{"o_orderkey": 1, broken',)], "value string").write.mode("append").text(path)
    rows, skipped = src.read_jsonl(spark, path, tolerant=True)
    return rows.select("o_orderkey", "o_orderstatus", F.lit(skipped).cast("long").alias("skipped"))


@register("snk2_defuse_all", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_acctbal < 0 THEN '''-' ELSE 'x-' END AS \"'=sign\" FROM customer")
def _(spark, d):
    sign = F.when(F.col("c_acctbal") < 0, "-").otherwise("x-")
    return src.defuse(read_table(spark, d, "customer").select("c_custkey", sign.alias("=sign")))


def _stored(spark, d):
    """Orders, saved, then cut to the finished ones in place."""
    store = src.Store(spark, _fresh(spark, "store"))
    store.save(read_table(spark, d, "orders"), "orders", operation={"filter": "import"})
    store.save(store.load("orders").where("o_orderstatus = 'F'"), "orders", source="orders", operation={"filter": "rules"})
    return store


@register("snk4_store_save", "SELECT o_orderkey, 'import,rules' AS history FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    store = _stored(spark, d)
    return store.load("orders").select("o_orderkey", F.lit(",".join(h["filter"] for h in store.history("orders"))).alias("history"))


@register("snk5_store_list", "SELECT 'customers' AS name, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    store = _stored(spark, d)
    store.save(read_table(spark, d, "customer"), "customers")
    store.save(read_table(spark, d, "nation"), "gone")
    store.delete("gone")
    return spark.createDataFrame([(x["name"], x["rows"]) for x in store.list()], "name string, rows long")


@register("agg14_mapped_columns", "SELECT text AS \"doc.text\", lang AS language, source AS \"the source\" FROM documents")
def _(spark, d):
    df, wanted = documents(spark, d).select("text", "lang", "source"), ["doc.text", "language", "the source"]
    found = {target: name for name, target in combine.suggest_mapping(wanted, df.columns).items() if target}
    mapped = {t: s for t, s in found.items() if s} | {"language": "lang"}
    return df.select(*[F.col(mapped[t]).alias(t) for t in wanted])


_GUIDES = ("'Nenne ' || p_size || ' Schlagwörter.'", "'Für Klasse ' || p_size || ' geeignete Begriffe.'", "'Höchstens ' || p_size || '-' || (p_size + 90) || ' Zeichen'", "'Fasse ' || p_name || ' in einem Satz zusammen.'", "'Ab ' || p_size || ' Jahren: drei treffende deutsche Schlagwörter'", "'Eine Liste von Begriffen zu ' || p_name")


@register("val7_states_length", f"""SELECT p_partkey, regexp_matches(g, '([0-9]|drei|einem) (treffende deutsche )?(Schlagw|Zeichen|Satz)') AS stated
FROM (SELECT p_partkey, CASE p_partkey % 6 {" ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(_GUIDES))} END AS g FROM part)""")
def _(spark, d):
    number = F.col("p_size").cast("string")
    guides = (
        F.concat(F.lit("Nenne "), number, F.lit(" Schlagwörter.")), F.concat(F.lit("Für Klasse "), number, F.lit(" geeignete Begriffe.")),
        F.concat(F.lit("Höchstens "), number, F.lit("-"), (F.col("p_size") + 90).cast("string"), F.lit(" Zeichen")),
        F.concat(F.lit("Fasse "), "p_name", F.lit(" in einem Satz zusammen.")),
        F.concat(F.lit("Ab "), number, F.lit(" Jahren: drei treffende deutsche Schlagwörter")), F.concat(F.lit("Eine Liste von Begriffen zu "), "p_name"),
    )
    guide = F.get(F.array(*guides), (F.col("p_partkey") % 6).cast("int"))
    return read_table(spark, d, "part").select("p_partkey", fl.length_is_stated(guide).alias("stated"))


_CORRIDORS = ", ".join(f"('{k}', {low}, {high})" for k, (low, high) in generate.CORRIDORS.items())


@register("flt10_removed_examples", f"SELECT doc_id AS row, left({CLEAN}, 120) AS removed FROM documents WHERE length({CLEAN}) NOT BETWEEN 200 AND 2000 ORDER BY doc_id LIMIT 5")
def _(spark, d):
    ctx = registry.Context("doc_id", ["text"])
    made = registry.run("length", documents(spark, d), {"min": 200, "max": 2000}, ctx)
    return registry.examples("length", documents(spark, d), made.df, ctx).select("row", "removed")


@register("txt4_changed_examples", f"SELECT doc_id AS row, left(text, 120) AS before, left({CLEAN}, 120) AS after FROM documents WHERE {CLEAN} <> text ORDER BY doc_id LIMIT 5")
def _(spark, d):
    ctx = registry.Context("doc_id", ["text"])
    made = registry.run("markup", documents(spark, d), {}, ctx)
    return registry.examples("markup", documents(spark, d), made.df, ctx).select("row", "before", "after")


@register("val9_corridors", f"""SELECT c.profile, count(*) FILTER (WHERE length({CLEAN}) BETWEEN c.low AND c.high) AS fitting FROM documents, (VALUES {_CORRIDORS}, ('custom', 50, 5000)) c(profile, low, high) GROUP BY 1""")
def _(spark, d):
    profiles = [{"name": k} for k in generate.CORRIDORS] + [{"min": 50, "max": 5000}]
    chosen = [generate.resolve_corridor(p) for p in profiles]
    size = documents(spark, d).select(F.length(tx.clean_text(F.col("text"))).alias("n"))
    fits = [F.struct(F.lit(k).alias("profile"), F.col("n").between(low, high).alias("fits")) for k, (low, high) in chosen]
    return size.select(F.explode(F.array(*fits)).alias("c")).groupBy("c.profile").agg(F.count_if("c.fits").alias("fitting"))


@register("tre1_outline", f"""WITH {TREE}, p AS (SELECT uri, depth, position, row_number() OVER (ORDER BY position) - 1 AS place FROM walk)
SELECT p.uri, p.depth, (SELECT count(*) FROM p q WHERE q.position = p.position OR starts_with(q.position, p.position || '/')) AS size, p.place FROM p""")
def _(spark, d):
    return outline.outline(concepts(spark, d))


@register("str4_leakage_gate_whole", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 3000)")
def _(spark, d):
    stream, path = _events(spark, d)
    reference = read_table(spark, d, "customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("user_id"))
    left = intake.without_leaks(stream.where("_corrupt_record IS NULL").select("event_id", "user_id"), reference, "user_id")
    intake.finish(left.select("event_id"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("str5_resume", "SELECT event_type AS label, least(200, count(DISTINCT user_id)) AS kept FROM events GROUP BY event_type")
def _(spark, d):
    """The first run sees one half of the events; the second, from the same checkpoint, only what came after."""
    path = _fresh(spark, "resume")
    rows = read_table(spark, d, "events").select(
        F.col("event_type").alias("label"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"),
        F.concat(F.lit("user "), "user_id").alias("description"), F.lit("").alias("keywords"),
    )
    needed = rows.select("label").distinct().withColumn("needed", F.lit(200).cast("long"))
    half = F.pmod(F.xxhash64("ord"), F.lit(2)) == 0
    for part in (rows.where(half), rows.where(~half)):
        part.write.mode("append").json(f"{path}/in")
        stream = intake.read_candidates(spark, f"{path}/in", rows.schema).where("_corrupt_record IS NULL").drop("_corrupt_record")
        intake.run_batch_gates(stream, f"{path}/out", f"{path}/state", (1, 100), needed).awaitTermination()
    done = spark.read.parquet(f"{path}/out").where("verdict = 'passed'")
    return done.groupBy("label").agg(F.count("*").alias("kept"))


@register("gen1_whole_prompts", """WITH n AS (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL), c AS (SELECT label, unnest([0, 1, 2, 3]) AS call FROM n),
s AS (SELECT DISTINCT lang AS label, 'Title ' || doc_id % 40 AS title, lang || ',' || source AS keywords, source AS description FROM documents),
t AS (SELECT c.label, call, title || ' | ' || description || ' | ' || keywords AS line, row_number() OVER (PARTITION BY c.label, call ORDER BY md5('42|' || c.label || '|' || call || '|' || title), title, title || ' | ' || description || ' | ' || keywords) AS k FROM c JOIN s ON c.label = s.label),
e AS (SELECT label, call, string_agg(line, '; ' ORDER BY k) AS shots FROM t WHERE k <= 4 GROUP BY ALL),
m AS (SELECT label, string_agg(title, '; ' ORDER BY doc_id) AS made FROM (SELECT lang AS label, doc_id, 'T' || doc_id AS title FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 15) GROUP BY label)
SELECT label, call, least(10, 35 - call * 10)::BIGINT AS n, 'Write ' || least(10, 35 - call * 10) || ' entries for Top → ' || label || '; facet: ' || ['overview', 'exercise', 'project'][call % 3 + 1] || '; description of 100 to 400 characters.' || chr(10)
|| 'Examples: ' || shots || chr(10) || 'Titles not to be repeated: ' || made || chr(10) || 'In German.' AS prompt FROM c JOIN e USING (label, call) JOIN m USING (label)""")
def _(spark, d):
    planned = _targets(spark, d, 35).where("label is not null").withColumn("anchor", F.concat(F.lit("Top → "), "label"))
    seeds = _entries(spark, d).select("label", "title", F.col("tags").alias("keywords")).distinct()
    seeds = seeds.withColumn("description", F.split("keywords", ",")[1])
    made = documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), F.concat(F.lit("T"), "doc_id").alias("title"))
    return generate.prompts(planned, seeds, guidance="In German.", made=made)


@register("bal1_whole_prompts", f"""WITH {_SHOWN}, s AS (SELECT label, count(*) AS support FROM e GROUP BY label), p AS (SELECT label, 200 - support AS planned FROM s WHERE support < 200),
t AS (SELECT label, string_agg('title: ' || title || ' | tags: ' || tags, chr(10) ORDER BY rank) AS told, greatest(300, floor(max(size) / 2))::BIGINT AS tokens FROM x GROUP BY label),
w AS (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY b.support DESC, b.label) AS k FROM s a JOIN s b ON a.label <> b.label),
apart AS (SELECT label, string_agg(other, '; ' ORDER BY k) || CASE WHEN any_value(m) > 0 THEN ' (and ' || any_value(m) || ' more)' ELSE '' END AS apart FROM (SELECT *, (SELECT count(*) FROM s) - 1 - 2 AS m FROM w) WHERE k <= 2 GROUP BY label),
h AS (SELECT label, greatest(10, floor(quantile_cont(length(title)::DOUBLE, 0.25) / 10 + 0.5) * 10)::BIGINT AS low, greatest(10, floor(quantile_cont(length(title)::DOUBLE, 0.75) / 10 + 0.5) * 10)::BIGINT AS high FROM e GROUP BY label),
a AS (SELECT label, string_agg(title, '; ' ORDER BY row) AS avoid FROM (SELECT label, title, row FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY row DESC) <= 15) GROUP BY label),
c AS (SELECT label, planned, unnest(range(0, ceil(planned / 10)::BIGINT)) AS call FROM p)
SELECT label, call::INT AS call, least(10, planned - call * 10)::BIGINT AS n, least(16000, 500 + least(10, planned - call * 10) * tokens)::BIGINT AS max_tokens,
'Write ' || least(10, planned - call * 10) || ' new entries for ''' || label || '''.' || chr(10) || 'Examples:' || chr(10) || told || chr(10) || 'Not to be confused with: ' || apart || chr(10) || 'Fields:' || chr(10)
|| '1. title (free text, ONE value; im Datensatz meist ' || CASE WHEN low = high THEN 'etwa ' || low ELSE low || '–' || high END || ' Zeichen)' || chr(10)
|| '2. tags (list in ONE string, separated by ","; at least 2 values; im Datensatz meist etwa 2 Werte)' || chr(10) || 'Not to be repeated: ' || avoid AS prompt
FROM c JOIN t USING (label) JOIN apart USING (label) JOIN h USING (label) JOIN a USING (label)""")
def _(spark, d):
    df = _entries(spark, d)
    shown = _shown(spark, d)
    apart = labels.contrast_labels(labels.edges(df, "doc_id", "label"), cap=2, with_rest=True)
    shapes = [labels.field_shapes(df, f, F.col("label")) for f in FIELDS]
    avoid = balance.avoided(df, "doc_id", F.array("label"), FIELDS[0])
    sizes = balance.entry_sizes(df, "doc_id", shown, FIELDS)
    return balance.prompts(df, "doc_id", balance.plan(df, "doc_id", "label", 200), shown, apart, FIELDS, shapes=shapes, avoid=avoid, sizes=sizes)


@register("bal2_answer_gates_known", """WITH a AS (SELECT doc_id AS ord, lang AS label, 'Title ' || doc_id % 80 AS title, CASE WHEN doc_id % 23 = 0 THEN lang ELSE lang || ', ' || source END AS tags FROM documents),
k AS (SELECT DISTINCT lower('Title ' || doc_id % 40 || chr(10) || lang || ', ' || source) AS print FROM documents), b AS (SELECT *, lower(title || chr(10) || tags) AS print, tags = label AS gap FROM a)
SELECT label, ord, title, tags, CASE WHEN gap THEN 'discarded_incomplete' WHEN print IN (SELECT print FROM k) OR row_number() OVER (PARTITION BY print, gap ORDER BY ord) > 1 THEN 'discarded_duplicate' ELSE 'accepted' END AS verdict FROM b""")
def _(spark, d):
    """Answers against the dataset's own rows, which hold half of the answers' titles."""
    tags = F.when(F.col("doc_id") % 23 == 0, F.col("lang")).otherwise(F.concat_ws(",", "lang", "source"))
    answers = documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), F.concat(F.lit("Title "), F.col("doc_id") % 80).alias("title"), tags.alias("tags"))
    return balance.gate(answers, FIELDS, known=balance.prints(_entries(spark, d), FIELDS))


@register("gen2_accept", """WITH RECURSIVE c AS (SELECT vec_id AS ord, 'L' || label AS label, 'T' || vec_id % 300 AS title, repeat('x', (3 + vec_id % 40)::INT) AS description, embedding::DOUBLE[] AS v FROM embeddings WHERE label > 0),
leak AS (SELECT DISTINCT c.ord FROM c JOIN embeddings r ON r.label = 0 AND list_cosine_similarity(c.v, r.embedding::DOUBLE[]) >= 0.35),
near AS (SELECT b.ord, list(a.ord) AS near FROM c a JOIN c b ON a.ord < b.ord AND list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY 1),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.ord) AS n, c.ord, c.label, lower(title || chr(10) || description) AS print, length(description) BETWEEN 5 AND 40 AS fits, leak.ord IS NOT NULL AS leaks, near
FROM c LEFT JOIN leak ON leak.ord = c.ord LEFT JOIN near ON near.ord = c.ord),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS ord, ''::VARCHAR AS label, ''::VARCHAR AS verdict, []::VARCHAR[] AS seen, []::BIGINT[] AS kept, []::VARCHAR[] AS held
UNION ALL SELECT n, ord, label, verdict, CASE WHEN verdict IN ('over_quota', 'discarded_length') THEN seen ELSE list_append(seen, print) END, CASE WHEN verdict = 'passed' THEN list_append(kept, ord) ELSE kept END,
CASE WHEN verdict = 'passed' THEN list_append(held, label) ELSE held END FROM (SELECT o.n, o.ord, o.label, o.print, walk.seen, walk.kept, walk.held,
CASE WHEN NOT o.fits THEN 'discarded_length' WHEN list_contains(walk.seen, o.print) THEN 'discarded_duplicate' WHEN len(list_filter(walk.held, lambda x: x = o.label)) >= 20 THEN 'over_quota'
WHEN o.leaks THEN 'discarded_leakage' WHEN o.near IS NOT NULL AND list_has_any(walk.kept, o.near) THEN 'discarded_semantic_duplicate' ELSE 'passed' END AS verdict FROM walk JOIN o ON o.n = walk.n + 1))
SELECT label, ord, verdict FROM walk WHERE n > 0""")
def _(spark, d):
    rows = read_table(spark, d, "embeddings")
    given = rows.where("label > 0").select(
        F.concat(F.lit("L"), "label").alias("label"), F.col("vec_id").alias("ord"), F.concat(F.lit("T"), F.col("vec_id") % 300).alias("title"),
        F.repeat(F.lit("x"), (3 + F.col("vec_id") % 40).cast("int")).alias("description"), F.lit("k").alias("keywords"), "embedding",
    )
    needed = given.select("label").distinct().withColumn("needed", F.lit(20).cast("long"))
    return generate.accept(given, "embedding", needed, (5, 40), rows.where("label = 0"), leakage=0.35, duplicate=0.35).select("label", "ord", "verdict")


@register("jn6_best_match", """SELECT x.vec_id, round(greatest(0, max(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 4) AS similarity FROM embeddings x, embeddings y WHERE y.label = 0 GROUP BY x.vec_id""")
def _(spark, d):
    rows = read_table(spark, d, "embeddings")
    found = vectors.best_match(rows, "vec_id", "embedding", rows.where("label = 0"), "embedding")
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"))


@register("tre1_languages", "SELECT 'n' || n_nationkey AS uri, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN upper(n_name) ELSE 'n' || n_nationkey END AS label FROM nation")
def _(spark, d):
    kind, nothing = F.col("n_nationkey") % 3, F.create_map().cast("map<string,string>")
    names = F.when(kind == 0, F.create_map(F.lit("en"), F.lit("?"), F.lit("de"), F.col("n_name"))).when(kind == 1, F.create_map(F.lit("fr"), F.upper("n_name"))).otherwise(nothing)
    nations = read_table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uri"), names.alias("labels"))
    return vocab.in_language(nations).select("uri", "label")


@register("agg4_analyze_pii", f"SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE e > 0) AS with_email, sum(e)::BIGINT AS email FROM (SELECT len(regexp_extract_all({CLEAN}, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+')) AS e FROM documents)")
def _(spark, d):
    both = labels.analyze(celled(spark, d), "doc_id", ["text"], "cell", pii=True)
    hit = documents(spark, d).agg(F.count_if(tx.pii_counts(tx.clean_text(F.col("text")))["email"] > 0).alias("with_email"))
    return both.select("rows_scanned", "email").crossJoin(hit)  # one row each
