"""Queries: columns, rules, keys, joins, profiles, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowforge.functions import text as tx
from rowforge.operators import columns, keys, profile, review, rules
from rowforge.plans.catalog import register
from rowforge.session import read_table, shared_folder
from rowforge.sources import tables as src


def _orders(spark, d):
    return tx.as_text_table(read_table(spark, d, "orders"))


def _by_rules(name: str, table: str, key: str, given: list[dict], sql: str, combine: str = "and") -> None:
    def build(spark, d):
        df = tx.as_text_table(read_table(spark, d, table))
        return rules.filter_rows(df, given, combine).df.select(F.col(key).cast("long").alias(key))

    register(name, f"SELECT {key} FROM {table} WHERE {sql}")(build)


@register("col1_select", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, d):
    return columns.select_columns(read_table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


@register("col2_drop", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def _(spark, d):
    return columns.drop_columns(read_table(spark, d, "part"), ["p_name", "p_retailprice"])


@register("col3_rename", "SELECT p_partkey AS id, p_brand AS brand, p_type AS p_type FROM part")
def _(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return columns.rename_columns(part, {"p_partkey": " id ", "p_brand": "brand", "p_type": "p_type"})


_by_rules("flt1_rules_and", "orders", "o_orderkey", [{"column": "o_orderstatus", "op": "eq", "value": "O"}, {"column": "o_totalprice", "op": "gte", "value": 100000}], "o_orderstatus = 'O' AND o_totalprice >= 100000")
_by_rules("flt1_rules_or", "orders", "o_orderkey", [{"column": "o_orderstatus", "op": "eq", "value": "P"}, {"column": "o_totalprice", "op": "lt", "value": 20000}], "o_orderstatus = 'P' OR o_totalprice < 20000", "or")
_by_rules("flt2_eq_number", "orders", "o_orderkey", [{"column": "o_custkey", "op": "eq", "value": 7}], "o_custkey = 7")
_by_rules("flt2_ne_unreadable", "orders", "o_orderkey", [{"column": "o_orderpriority", "op": "ne", "value": 1}], "NOT coalesce(try_cast(o_orderpriority AS DOUBLE) = 1, false)")
_by_rules("flt3_ordered_number", "orders", "o_orderkey", [{"column": "o_totalprice", "op": "lte", "value": 50000.5}], "o_totalprice <= 50000.5")
_by_rules("flt3_ordered_text", "orders", "o_orderkey", [{"column": "o_orderpriority", "op": "gt", "value": "3"}], "o_orderpriority > '3'")
_by_rules("flt4_between_number", "orders", "o_orderkey", [{"column": "o_totalprice", "op": "between", "value": 1000, "value2": 90000}], "o_totalprice BETWEEN 1000 AND 90000")
_by_rules("flt4_between_text", "orders", "o_orderkey", [{"column": "o_orderpriority", "op": "between", "value": "2", "value2": "4"}], "o_orderpriority BETWEEN '2' AND '4'")
_by_rules("flt5_in", "orders", "o_orderkey", [{"column": "o_custkey", "op": "in", "value": [1, 2, "3", 10]}], "o_custkey IN (1, 2, 3, 10)")
_by_rules("flt5_not_in", "orders", "o_orderkey", [{"column": "o_orderstatus", "op": "not_in", "value": ["O", "F"]}], "o_orderstatus NOT IN ('O', 'F')")
_by_rules("flt6_contains", "part", "p_partkey", [{"column": "p_type", "op": "contains", "value": "STEEL"}], "contains(lower(p_type), 'steel')")
_by_rules("flt6_starts_ends", "part", "p_partkey", [{"column": "p_brand", "op": "starts_with", "value": "brand#1"}, {"column": "p_brand", "op": "ends_with", "value": "3", "case_sensitive": True}], "starts_with(lower(p_brand), 'brand#1') OR ends_with(p_brand, '3')", "or")
_by_rules("flt7_regex", "part", "p_partkey", [{"column": "p_brand", "op": "regex", "value": "^BRAND#[1-3][24]$"}], "regexp_matches(p_brand, '^brand#[1-3][24]$', 'i')")


@register("flt8_is_empty", "SELECT o_orderkey, o_orderstatus = 'O' AS blank FROM orders")
def _(spark, d):
    df = _orders(spark, d).withColumn("s", F.when(F.col("o_orderstatus") == "O", " \t").otherwise(F.col("o_orderstatus")))
    empty = rules.filter_rows(df, [{"column": "s", "op": "is_empty"}]).df.select("o_orderkey", F.lit(True).alias("blank"))
    filled = rules.filter_rows(df, [{"column": "s", "op": "not_empty"}]).df.select("o_orderkey", F.lit(False).alias("blank"))
    return empty.unionByName(filled).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@register(
    "flt9_not_comparable",
    """SELECT count(*) AS before, count(*) FILTER (WHERE o_orderstatus = 'O') AS after, count(*) FILTER (WHERE o_orderstatus <> 'O') AS removed,
    count(*) FILTER (WHERE try_cast(o_orderpriority AS DOUBLE) IS NULL) AS not_comparable FROM orders""",
)
def _(spark, d):
    given = [{"column": "o_orderpriority", "op": "lt", "value": 3}, {"column": "o_orderstatus", "op": "eq", "value": "O"}]
    return rules.filter_rows(_orders(spark, d), given, "or").stats


@register("flt13_page", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(n_nationkey::VARCHAR, '1') ORDER BY n_nationkey LIMIT 5 OFFSET 2")
def _(spark, d):
    return review.page(read_table(spark, d, "nation"), "n_nationkey", "1", ["n_nationkey", "n_name"], 2, 5).df


@register("flt13_page_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE contains(lower(p_type), 'a') OR contains(lower(p_brand), 'a')) AS matched FROM part")
def _(spark, d):
    return review.page(read_table(spark, d, "part"), "p_partkey", "A", ["p_brand", "p_type"]).stats


_DUP = """WITH k AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_custkey::VARCHAR END AS a, o_orderpriority AS b FROM orders),
c AS (SELECT a, b, count(*) AS n FROM k WHERE a <> '' AND b <> '' GROUP BY ALL)
SELECT (SELECT count(*) FROM k) AS rows, count(*) AS unique_keys, (SELECT count(*) FROM k WHERE a = '' OR b = '') AS empty_key_rows,
count(*) FILTER (WHERE n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_rows,
coalesce(sum(n - 1) FILTER (WHERE n > 1), 0)::BIGINT AS removable_rows FROM c"""


def _keyed_orders(spark, d):
    part = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string"))
    return read_table(spark, d, "orders").withColumn("a", part)


@register("key1_agg3_duplicate_report", _DUP)
def _(spark, d):
    return keys.duplicate_report(_keyed_orders(spark, d), ["a", "o_orderpriority"])


@register("agg3_duplicate_examples", "SELECT o_custkey::VARCHAR AS o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY count(*) DESC, o_custkey::VARCHAR LIMIT 5")
def _(spark, d):
    return keys.duplicate_examples(read_table(spark, d, "orders"), ["o_custkey"])


for _keep, _direction in (("first", "ASC"), ("last", "DESC")):

    def _build(spark, d, keep=_keep):
        return keys.dedupe_keys(_keyed_orders(spark, d), ["a", "o_orderpriority"], "o_orderkey", keep).select("o_orderkey")

    register(
        f"win2_dedupe_keys_{_keep}",
        f"""SELECT o_orderkey FROM orders QUALIFY o_orderstatus = 'P' OR row_number() OVER (PARTITION BY o_orderstatus = 'P', o_custkey, o_orderpriority ORDER BY o_orderkey {_direction}) = 1""",
    )(_build)

_CARD = """WITH l AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l.n AS ln, r.n AS rn FROM l FULL JOIN r ON l.k = r.k)
SELECT (SELECT count(*) FROM orders) AS left_rows, coalesce(sum(rn), 0)::BIGINT AS right_rows, count(ln) AS left_unique_keys, count(rn) AS right_unique_keys,
max(ln) AS left_max_repeat, max(rn) AS right_max_repeat, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS left_unusable_key_rows,
0::BIGINT AS right_unusable_key_rows,
(coalesce(sum(ln) FILTER (WHERE rn IS NULL), 0) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'))::BIGINT AS left_unmatched_rows,
coalesce(sum(rn) FILTER (WHERE ln IS NULL), 0)::BIGINT AS right_unmatched_rows,
count(*) FILTER (WHERE ln IS NOT NULL AND rn IS NOT NULL) AS matching_keys, count(*) FILTER (WHERE rn IS NULL) AS left_only_keys,
count(*) FILTER (WHERE ln IS NULL) AS right_only_keys, coalesce(sum(ln * rn), 0)::BIGINT AS estimated_rows,
CASE WHEN max(ln) > 1 THEN 'many' ELSE 'one' END || '-to-' || CASE WHEN max(rn) > 1 THEN 'many' ELSE 'one' END AS relation,
coalesce(sum(ln * rn), 0) > greatest((SELECT count(*) FROM orders), sum(rn)) AS explodes FROM b"""


@register("jn1_cardinality", _CARD)
def _(spark, d):
    left = read_table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderkey").cast("string")))
    right = read_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return keys.cardinality(left, right, [("k", "l_orderkey")])


def _nations(spark, d):
    return read_table(spark, d, "nation").where("n_regionkey > 0")


def _regions(spark, d):
    return read_table(spark, d, "region").where("r_regionkey < 3")


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    def _build(spark, d, how=_how):
        return keys.join_tables(_nations(spark, d), _regions(spark, d), [("n_regionkey", "r_regionkey")], how).df

    register(
        f"jn2_join_{_how}",
        f"""SELECT coalesce(n_nationkey::VARCHAR, '') AS n_nationkey, coalesce(n_name, '') AS n_name, coalesce(n_regionkey, r_regionkey)::VARCHAR AS n_regionkey,
        coalesce(r_name, '') AS r_name FROM (SELECT * FROM nation WHERE n_regionkey > 0) {_join} (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""",
    )(_build)


@register(
    "jn2_join_two_keys",
    """SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, coalesce(m.tag, '') AS tag FROM lineitem LEFT JOIN
    (SELECT o_orderkey, 1 AS n, o_orderpriority AS tag FROM orders) m ON l_orderkey = m.o_orderkey AND l_linenumber = m.n""",
)
def _(spark, d):
    right = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n"), F.col("o_orderpriority").alias("tag"))
    left = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return keys.join_tables(left, right, [("l_orderkey", "k"), ("l_linenumber", "n")], "left", max_rows=None).df


def _named(spark, d):
    left = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("label"))
    right = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))
    return left, right


@register("jn3_suffix", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS label, n_name AS label_right FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return keys.join_tables(*_named(spark, d), [("c_nationkey", "key")], "inner").df


@register("jn3_coalesce", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return keys.join_tables(*_named(spark, d), [("c_nationkey", "key")], "inner", coalesce=True).df


@register("jn4_forecast", "SELECT count(*) AS expected_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    pairs = [("c_custkey", "o_custkey")]
    return keys.join_tables(read_table(spark, d, "customer"), read_table(spark, d, "orders"), pairs, "left", max_rows=None).stats.select("expected_rows")


@register("jn5_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return keys.unmatched(read_table(spark, d, "customer"), read_table(spark, d, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


_PROFILED = ["p_brand", "p_type", "p_size"]
_MELT = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column, trim({c}::VARCHAR) AS v FROM part" for i, c in enumerate(_PROFILED))


@register(
    "agg1_profile",
    f"""SELECT position, "column", count(*) FILTER (WHERE v <> '') AS filled, count(*) FILTER (WHERE v = '') AS empty,
    round(count(*) FILTER (WHERE v <> '') / count(*), 4) AS fill_rate, count(DISTINCT v) FILTER (WHERE v <> '') AS distinct,
    CASE WHEN count(try_cast(v AS DOUBLE)) >= 0.8 * count(*) THEN 'numeric' ELSE 'text' END AS kind FROM ({_MELT.replace("AS column", 'AS "column"')}) GROUP BY ALL""",
)
def _(spark, d):
    return profile.profile_columns(read_table(spark, d, "part").select(*_PROFILED))


@register(
    "agg1_top_values",
    f"""SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS rank, v AS value, n AS count
    FROM (SELECT "column", v, count(*) AS n FROM ({_MELT.replace("AS column", 'AS "column"')}) GROUP BY ALL) QUALIFY rank <= 10""",
)
def _(spark, d):
    return profile.top_values(read_table(spark, d, "part").select(*_PROFILED))


_NUMBERS = ["l_quantity", "l_discount", "l_linenumber"]


@register(
    "agg2_numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS parsed, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(avg({c}), 6) AS mean,
        round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.05), 6) AS p05, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS p95 FROM lineitem"""
        for c in _NUMBERS
    ),
)
def _(spark, d):
    return profile.numeric_summary(read_table(spark, d, "lineitem"), _NUMBERS)


@register("src4_flatten", "SELECT event_id::VARCHAR AS event_id, event_type AS \"kind.type\", user_id::VARCHAR AS \"kind.user.id\", event_type || ',' || user_id AS \"kind.list\" FROM events")
def _(spark, d):
    user = F.struct(F.col("user_id").alias("id"))
    pair = F.array(F.col("event_type"), F.col("user_id").cast("string"))
    nested = read_table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("type"), user.alias("user"), pair.alias("list")).alias("kind"))
    return src.flatten(nested)


@register(
    "src5_union_records",
    """SELECT coalesce(s_suppkey::VARCHAR, '') AS s_suppkey, coalesce(s_name, '') AS s_name, coalesce(c_custkey::VARCHAR, '') AS c_custkey, coalesce(c_name, '') AS c_name
    FROM (SELECT s_suppkey, s_name FROM supplier UNION ALL BY NAME SELECT c_custkey, c_name FROM customer)""",
)
def _(spark, d):
    return src.union_records([read_table(spark, d, "supplier").select("s_suppkey", "s_name"), read_table(spark, d, "customer").select("c_custkey", "c_name")])


def _fresh(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@register("src1_snk1_csv_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, ' \"' || n_name || '\"; x ' AS n_name FROM nation")
def _(spark, d):
    path = _fresh(spark, "csv")
    odd = read_table(spark, d, "nation").select("n_nationkey", F.concat(F.lit(' "'), "n_name", F.lit('"; x ')).alias("n_name"))
    src.write_table(odd, path, "csv", gzip=True)
    return src.read_csv(spark, path)


@register("snk1_jsonl_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents")
def _(spark, d):
    path = _fresh(spark, "jsonl")
    src.write_table(read_table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path, "jsonl")
    return src.read_jsonl(spark, path, schema=spark.read.json(path).schema)[0]


@register("snk2_defuse", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_acctbal < 0 THEN '''-' ELSE '+' END AS \"'=sign\" FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 0 FROM customer WHERE FALSE)")
def _(spark, d):
    rows = read_table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("-").alias("=sign"))
    return src.defuse(rows)
