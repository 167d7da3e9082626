"""Queries: samples, term banks, balancing, enrichment, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions.fields import TextField
from rowforge.operators import balance, enrich, generate, labels, review
from rowforge.plans.catalog import register
from rowforge.plans.labels import DOCS, celled, documents

FIELDS = [TextField("title"), TextField("tags", ",", 2)]


def samples(spark, d):
    """Documents as generated samples."""
    status = F.when(F.col("doc_id") % 3 == 0, "passed").when(F.col("doc_id") % 3 == 1, "approved").otherwise("rejected")
    return documents(spark, d).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("concept"), status.alias("status"), (F.col("doc_id") % 100 / 100).alias("sim_max"),
        F.concat(F.lit("t"), F.col("doc_id") % 50).alias("title"), F.col("source").alias("description"), F.col("lang").alias("keywords"),
    )


SAMPLES = """s AS (SELECT doc_id AS id, lang AS concept, CASE doc_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, doc_id % 100 / 100 AS sim_max,
't' || doc_id % 50 AS title, source AS description, lang AS keywords FROM documents)"""


@register("flt14_browse", f"WITH {SAMPLES} SELECT id FROM s WHERE concept = 'en' AND status = 'approved' AND sim_max >= 0.5")
def _(spark, d):
    return review.browse(samples(spark, d), "en", "approved", 0.5).select("id")


@register("flt15_update_status", f"WITH {SAMPLES} SELECT id, CASE WHEN id % 7 = 0 THEN 'approved' ELSE status END AS status FROM s")
def _(spark, d):
    updates = documents(spark, d).where("doc_id % 7 = 0").select((F.col("doc_id")).alias("id"), F.lit("approved").alias("new_status"))
    updates = updates.unionByName(updates.select((F.col("id") + 10_000_000_000).alias("id"), F.lit("rejected").alias("new_status")))
    return review.update_status(samples(spark, d), updates).select("id", "status")


@register("snk3_training_export", f"WITH {SAMPLES} SELECT title, description, keywords, upper(concept) AS \"label_DISPLAYNAME\", concept AS label, 'synthetic' AS source, concept AS generated_for FROM s WHERE status <> 'rejected'")
def _(spark, d):
    named = documents(spark, d).select(F.col("lang").alias("uri"), F.upper("lang").alias("label")).distinct()
    return generate.training_export(samples(spark, d), named)


def _targets(spark, d, needed: int):
    return documents(spark, d).select(F.col("lang").alias("label")).distinct().withColumn("needed", F.lit(needed).cast("long"))


@register("agg12_audit", f"WITH {SAMPLES} SELECT concept AS label, count(*) AS made, 50::BIGINT AS target, round(avg(sim_max), 4) AS mean_sim, round(max(sim_max), 4) AS max_sim FROM s WHERE status <> 'rejected' GROUP BY concept")
def _(spark, d):
    return generate.audit(samples(spark, d).withColumnRenamed("concept", "label"), _targets(spark, d, 50))


@register("gen3_still_needed", f"WITH {SAMPLES} SELECT concept AS label, greatest(0, 150 - count(*) FILTER (WHERE status <> 'rejected'))::BIGINT AS needed FROM s GROUP BY concept")
def _(spark, d):
    return generate.still_needed(_targets(spark, d, 150), samples(spark, d).withColumnRenamed("concept", "label"))


_STOP = ", ".join(f"'{w}'" for w in generate.STOP_WORDS)


@register("agg11_term_bank", f"""WITH r AS (SELECT doc_id, source AS label, list_concat([lang], list_filter(list_transform(regexp_extract_all(text, '{generate.TOKEN}'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS terms FROM documents),
m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 500), c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(terms) AS term FROM m) GROUP BY ALL),
k AS (SELECT count(DISTINCT label) AS k FROM c), f AS (SELECT term FROM c, k GROUP BY term HAVING any_value(k) >= 6 AND count(*) > greatest(5, floor(0.4 * any_value(k)))),
o AS (SELECT * FROM c WHERE term NOT IN (FROM f) QUALIFY row_number() OVER (PARTITION BY label, lower(term) ORDER BY n DESC, term) = 1)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY n DESC, term)::INT AS rank, term FROM o QUALIFY rank <= 20""")
def _(spark, d):
    return generate.term_bank(documents(spark, d), "doc_id", "source", ["lang"], ["text"], top_n=20)


@register("win5_distill", """WITH p AS (SELECT lang AS label, md5(lower(lang || chr(10) || source)) AS print, min(doc_id) AS row FROM documents GROUP BY ALL)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || label || '|' || print), row)::INT AS rank, row FROM p QUALIFY rank <= 6""")
def _(spark, d):
    return generate.distill(documents(spark, d), "doc_id", "lang", "lang", "source")


_EXAMPLES = """x AS (SELECT doc_id AS row, lang AS label, length(source) + length(left(text, 40)) AS size, doc_id % 5 = 0 AS touched, source <> '' AND left(text, 40) <> '' AS whole, md5(lower(source || chr(10) || left(text, 40))) AS print FROM e),
md AS (SELECT label, coalesce(quantile_cont(size::DOUBLE, 0.5) FILTER (WHERE whole AND NOT touched), quantile_cont(size::DOUBLE, 0.5) FILTER (WHERE NOT touched), quantile_cont(size::DOUBLE, 0.5)) AS median FROM x GROUP BY label),
y AS (SELECT x.*, median FROM x JOIN md USING (label) QUALIFY row_number() OVER (PARTITION BY label, print ORDER BY touched, NOT whole, abs(size - median), size DESC, row) = 1)"""


def _picked(df):
    return balance.pick_examples(df, "doc_id", F.array("lang"), [TextField("source"), TextField("text")], 4, F.col("doc_id") % 5 == 0)


@register("win6_pick_examples", f"""WITH e AS (SELECT doc_id, lang, source, trim(regexp_replace(left(text, 40), '\\s+', ' ', 'g')) AS text FROM documents), {_EXAMPLES}
SELECT label, row_number() OVER (PARTITION BY label ORDER BY touched, NOT whole, abs(size - median), size DESC, row)::INT AS rank, row FROM y QUALIFY rank <= 4""")
def _(spark, d):
    df = documents(spark, d).withColumn("text", F.trim(F.regexp_replace(F.substring("text", 1, 40), "\\s+", " ")))
    return _picked(df)


_ENDS = r"'^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g'"
_WHOLE = _EXAMPLES.replace("left(text, 40)", "text").replace("lower(source || chr(10) || text)", "replace(lower(source || chr(10) || text), 'ß', 'ss')")


@register("win6_pick_whole_examples", f"""WITH e AS (SELECT doc_id, lang, regexp_replace(coalesce(source, ''), {_ENDS}) AS source, regexp_replace(coalesce(text, ''), {_ENDS}) AS text FROM documents), {_WHOLE}
SELECT label, row_number() OVER (PARTITION BY label ORDER BY touched, NOT whole, abs(size - median), size DESC, row)::INT AS rank, row FROM y QUALIFY rank <= 4""")
def _(spark, d):
    return _picked(documents(spark, d))


_PLAN = """e AS (SELECT doc_id % 11 = 0 AS made, unnest([lang, source]) AS label FROM documents), s AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE made) AS made FROM e GROUP BY label),
d AS (SELECT *, greatest(0, 120 - support) AS deficit FROM s), q AS (SELECT *, coalesce(sum(deficit) OVER (ORDER BY support, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d),
p AS (SELECT label, support, made, deficit::BIGINT AS deficit, greatest(0, least(deficit, 500 - used))::BIGINT AS planned FROM q)"""


def _planned(spark, d):
    df = celled(spark, d).withColumn("generated_for", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(""))
    return balance.plan(df, "doc_id", "cell", 120, limit=500)


@register("win7_balance_plan", f"""WITH {_PLAN} SELECT label, support, deficit, planned, ceil(planned / 10)::BIGINT AS batches, CASE WHEN planned > 0 THEN ceil(planned / 10) + 2 ELSE 0 END::BIGINT AS max_batches,
round((made + planned) / (support + planned), 3) AS synthetic_share, FALSE AS skipped FROM p""")
def _(spark, d):
    return _planned(spark, d)


@register("bal4_totals", f"""WITH {_PLAN} SELECT 120 AS target_per_label, sum(planned)::BIGINT AS rows_to_add, sum(ceil(planned / 10))::BIGINT AS batches, coalesce(sum(ceil(planned / 10) + 2) FILTER (WHERE planned > 0), 0)::BIGINT AS max_batches,
count(*) FILTER (WHERE deficit > 0) AS labels_below_target, count(*) FILTER (WHERE planned < deficit) AS labels_cut_by_limit, 0::BIGINT AS skipped_without_examples FROM p""")
def _(spark, d):
    return balance.totals(_planned(spark, d), 120)


def _entries(spark, d):
    """Documents as rows with a title, tags and a label."""
    tags = F.concat_ws(",", "lang", "source")
    return documents(spark, d).select("doc_id", F.concat(F.lit("Title "), F.col("doc_id") % 40).alias("title"), tags.alias("tags"), F.col("lang").alias("label"))


def _shown(spark, d):
    return balance.pick_examples(_entries(spark, d), "doc_id", F.array("label"), FIELDS, 3)


_SHOWN = """e AS (SELECT doc_id AS row, 'Title ' || doc_id % 40 AS title, lang || ', ' || source AS tags, lang AS label, length('Title ' || doc_id % 40) + length(lang || ', ' || source) AS size FROM documents),
md AS (SELECT label, quantile_cont(size::DOUBLE, 0.5) AS median FROM e GROUP BY label), o AS (SELECT e.*, median FROM e JOIN md USING (label) QUALIFY row_number() OVER (PARTITION BY label, lower(title || chr(10) || tags) ORDER BY abs(size - median), size DESC, row) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(size - median), size DESC, row)::INT AS rank FROM o QUALIFY rank <= 3)"""


@register("win8_entry_sizes", f"""WITH {_SHOWN} SELECT label, greatest(300, floor(max(size) / 2))::BIGINT AS entry_tokens, least(floor(min(length(title)) / 4), 40)::BIGINT AS min_chars_title, 0::BIGINT AS min_chars_tags,
greatest(1, least(10, floor(15500 / greatest(300, floor(max(size) / 2)))))::BIGINT AS per_call FROM x GROUP BY label""")
def _(spark, d):
    sizes = balance.entry_sizes(_entries(spark, d), "doc_id", _shown(spark, d), FIELDS)
    return sizes.withColumn("per_call", balance.per_call(F.col("entry_tokens")))


@register("bal1_prompts")
def _(spark, d):
    df = _entries(spark, d)
    apart = labels.contrast_labels(labels.edges(df, "doc_id", "label"), cap=5)
    return balance.prompts(df, "doc_id", balance.plan(df, "doc_id", "label", 200), _shown(spark, d), apart, FIELDS)


def _answers(spark, d):
    """Documents as answers of a model: some incomplete, some short, some repeated."""
    title = F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 19 == 0, "T").otherwise(F.concat(F.lit("Answer "), F.col("doc_id") % 300))
    tags = F.when(F.col("doc_id") % 23 == 0, F.col("lang")).otherwise(F.concat_ws(";", "lang", "source"))
    return documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), title.alias("title"), F.translate(tags, ";", ",").alias("tags"))


_GATED = """a AS (SELECT lang AS label, doc_id AS ord, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'T' ELSE 'Answer ' || doc_id % 300 END AS title, CASE WHEN doc_id % 23 = 0 THEN lang ELSE lang || ', ' || source END AS tags FROM documents),
e AS (SELECT *, CASE WHEN title = '' OR tags = label THEN 'discarded_incomplete' WHEN length(title) < 3 THEN 'discarded_short' END AS early FROM a),
f AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, lower(title || chr(10) || tags) ORDER BY ord) > 1 THEN 'discarded_duplicate' END) AS v FROM e),
g AS (SELECT *, coalesce(v, CASE WHEN row_number() OVER (PARTITION BY label, v IS NULL ORDER BY ord) > 60 THEN 'over_quota' END, 'accepted') AS verdict FROM f)"""


def _gated(spark, d):
    floors = _targets(spark, d, 0).select("label", F.lit(3).alias("min_chars_title"))
    floors = floors.withColumn("min_chars_tags", F.lit(0))
    wanted = _targets(spark, d, 60).withColumnRenamed("needed", "planned")
    return balance.gate(_answers(spark, d), FIELDS, floors, wanted=wanted)


@register("bal2_answer_gates", f"WITH {_GATED} SELECT label, ord, title, tags, verdict FROM g")
def _(spark, d):
    return _gated(spark, d)


@register("bal3_assemble", f"""WITH {_SHOWN}, {_GATED.replace("e AS", "e2 AS").replace("FROM e)", "FROM e2)")}
SELECT e.row::VARCHAR AS doc_id, title, lang || ',' || source AS tags, label, '' AS generated_for, CASE WHEN row IN (SELECT row FROM x) THEN label ELSE '' END AS example_for, '' AS enriched_fields FROM e JOIN documents ON row = doc_id
UNION ALL SELECT '', title, tags, label, label, '', '' FROM g WHERE verdict = 'accepted'""")
def _(spark, d):
    accepted = _gated(spark, d).where("verdict = 'accepted'").drop("verdict", "ord")
    return balance.assemble(_entries(spark, d), "doc_id", accepted, _shown(spark, d), "label")


def _gappy(spark, d):
    tags = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.concat_ws(",", "lang", "source"))
    return documents(spark, d).select("doc_id", "text", tags.alias("tags"), F.col("lang").alias("label"))


_ENRICHED = [TextField("text"), TextField("tags", ",", 2, "Two to six words.")]


@register("enr1_prompts", f"""WITH {DOCS}, p AS (SELECT min(doc_id) AS row FROM docs WHERE doc_id % 4 = 0 GROUP BY {DOCS.split('AS (SELECT *, ')[1].split(' AS t FROM')[0].replace("coalesce(text, '')", "text || chr(32) || lang")}, lang)
SELECT row, 'Filed under: ' || lang || chr(10) || 'text: "' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '"' || chr(10) || 'Already there, not to be repeated: ' || lang || chr(10) || 'Write the field ''tags''. Two to six words.' AS prompt
FROM p JOIN documents ON row = doc_id""")
def _(spark, d):
    return enrich.prompts(_gappy(spark, d), "doc_id", _ENRICHED, "tags", "label", limit=1_000_000).select("row", "prompt")


@register("enr2_apply_answers", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang || ', one, [email]' ELSE lang || ',' || source END AS tags, CASE WHEN doc_id % 4 = 0 THEN 'tags' ELSE '' END AS enriched_fields FROM documents""")
def _(spark, d):
    df = _gappy(spark, d)
    asked = enrich.prompts(df, "doc_id", _ENRICHED, "tags", "label", limit=1_000_000)
    answers = enrich.run_hook(asked, lambda prompt: ["one, One", "me@mail.org"], "twin")
    return enrich.apply_answers(df, "doc_id", _ENRICHED, "tags", answers, "label").select("doc_id", "tags", "enriched_fields")




@register("gen1_prompts")
def _(spark, d):
    planned = _targets(spark, d, 35).withColumn("anchor", F.concat(F.lit("Top → "), "label"))
    seeds = _entries(spark, d).select("label", "title").distinct()
    terms = generate.term_bank(documents(spark, d), "doc_id", "lang", ["source"], [], top_n=20)
    return generate.prompts(planned, seeds, terms)


def _candidates(spark, d):
    return documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), F.concat(F.lit("T"), F.col("doc_id") % 400).alias("title"), F.col("source").alias("description"), F.lit("k").alias("keywords"))


@register("gen2_gates", """WITH c AS (SELECT lang AS label, doc_id AS ord, 'T' || doc_id % 400 AS title, source AS description, length(source) BETWEEN 5 AND 90 AS fits FROM documents),
v AS (SELECT *, CASE WHEN NOT fits THEN 'discarded_length' WHEN row_number() OVER (PARTITION BY fits, lower(title || chr(10) || description) ORDER BY ord) > 1 OR ord >= 1000000000 THEN 'discarded_duplicate' ELSE 'passed' END AS w FROM c)
SELECT label, ord, CASE WHEN w = 'passed' AND row_number() OVER (PARTITION BY label, w = 'passed' ORDER BY ord) > 70 THEN 'over_quota' ELSE w END AS verdict FROM v""")
def _(spark, d):
    gated = generate.cheap_gates(_candidates(spark, d), (5, 90))
    return generate.quota_gate(gated, _targets(spark, d, 70)).select("label", "ord", "verdict")


@register("gen2_discards", """WITH c AS (SELECT doc_id AS ord, 'T' || doc_id % 400 AS title, source AS description, length(source) BETWEEN 5 AND 90 AS fits FROM documents)
SELECT CASE WHEN NOT fits THEN 'discarded_length' WHEN n > 1 THEN 'discarded_duplicate' ELSE 'passed' END AS verdict, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY fits, lower(title || chr(10) || description) ORDER BY ord) AS n FROM c) GROUP BY 1""")
def _(spark, d):
    return generate.discards(generate.cheap_gates(_candidates(spark, d), (5, 90)))


@register("trm1_refine_terms", """WITH t AS (SELECT lang AS label, doc_id AS ord, source AS term FROM documents), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY label, lower(term) ORDER BY ord) = 1)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY ord)::INT AS rank, term FROM o QUALIFY rank <= 12""")
def _(spark, d):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("source"))
    answers = documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), mixed.alias("term"))
    return generate.refine_terms(answers, 12)


@register("sed1_seed_answers", "SELECT lang AS label, doc_id AS ord, 'T' || doc_id AS title, source AS description, '[email]' AS keywords, 'bootstrap' AS source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 8")
def _(spark, d):
    answers = documents(spark, d).select(F.col("lang").alias("label"), F.col("doc_id").alias("ord"), F.concat(F.lit("T"), "doc_id").alias("title"), F.col("source").alias("description"), F.lit("me@mail.org").alias("keywords"))
    return generate.seed_answers(answers, 8)


@register("bal_foreign_marks", "SELECT count(*) AS rows, min('m' || doc_id % 3) AS example FROM documents WHERE doc_id % 11 = 0 AND 'm' || doc_id % 3 NOT IN (SELECT lang FROM documents)")
def _(spark, d):
    mark = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("m"), F.col("doc_id") % 3)).otherwise("")
    return balance.foreign_marks(documents(spark, d).withColumn("generated_for", mark), "doc_id", "lang")


