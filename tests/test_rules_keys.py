import pytest
from pyspark.sql import functions as F

from rowforge.operators import columns, keys, profile, review, rules

ROWS = [("Optik", "2015", "a", "x"), ("Akustik", "2020", "", "y"), (" ", None, "n/a", "x"), ("Mechanik", "abc", "b", " ")]
SCHEMA = "title string, year string, uri string, kind string"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def kept(table, *given, combine="and"):
    return [r["title"] for r in rules.filter_rows(table, list(given), combine).df.collect()]


@pytest.mark.parametrize(
    ("rule", "titles"),
    [
        ({"column": "year", "op": "gte", "value": 2015}, ["Optik", "Akustik"]),
        ({"column": "year", "op": "gte", "value": "2015"}, ["Optik", "Akustik", "Mechanik"]),
        ({"column": "year", "op": "ne", "value": 2015}, ["Akustik", " ", "Mechanik"]),
        ({"column": "year", "op": "between", "value": 2016, "value2": 2020}, ["Akustik"]),
        ({"column": "title", "op": "contains", "value": "TIK"}, ["Optik", "Akustik"]),
        ({"column": "title", "op": "contains", "value": "TIK", "case_sensitive": True}, []),
        ({"column": "title", "op": "regex", "value": "^m.*k$"}, ["Mechanik"]),
        ({"column": "title", "op": "is_empty"}, [" "]),
        ({"column": "uri", "op": "not_empty"}, ["Optik", " ", "Mechanik"]),
        ({"column": "kind", "op": "in", "value": ["x"]}, ["Optik", " "]),
        ({"column": "kind", "op": "not_in", "value": ["x"]}, ["Akustik", "Mechanik"]),
    ],
)
def test_rule(table, rule, titles):
    assert kept(table, rule) == titles


def test_combination_and_stats(table):
    both = [{"column": "kind", "op": "eq", "value": "x"}, {"column": "year", "op": "lt", "value": 2018}]
    assert kept(table, *both) == ["Optik"]
    assert kept(table, *both, combine="or") == ["Optik", " "]
    stats = rules.filter_rows(table, both).stats.first()
    assert (stats["before"], stats["after"], stats["removed"], stats["not_comparable"]) == (4, 1, 3, 2)


@pytest.mark.parametrize(
    "rule",
    [
        {"column": "nope", "op": "eq", "value": 1},
        {"column": "title", "op": "like", "value": 1},
        {"column": "title", "op": "regex", "value": "("},
        {"column": "title", "op": "regex", "value": "a" * 201},
        {"column": "year", "op": "between", "value": 1},
        {"column": "year", "op": "in", "value": "x"},
    ],
)
def test_bad_rules(table, rule):
    with pytest.raises(ValueError):
        rules.condition([rule], table.columns)


def test_no_rules_and_bad_combination(table):
    with pytest.raises(ValueError):
        rules.condition([], table.columns)
    with pytest.raises(ValueError):
        rules.condition([{"column": "title", "op": "is_empty"}], table.columns, "xor")


def test_columns(table):
    assert columns.select_columns(table, ["uri", "title"]).columns == ["uri", "title"]
    assert columns.drop_columns(table, ["uri"]).columns == ["title", "year", "kind"]
    assert columns.rename_columns(table, {"uri": " link "}).columns == ["title", "year", "link", "kind"]
    for call in (
        lambda: columns.select_columns(table, ["uri", "uri"]),
        lambda: columns.drop_columns(table, table.columns),
        lambda: columns.rename_columns(table, {"uri": "title"}),
        lambda: columns.rename_columns(table, {"uri": " "}),
        lambda: columns.select_columns(table, ["nope"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_dotted_names(spark):
    df = spark.createDataFrame([("1", "a")], ["id", "properties.title"])
    assert columns.select_columns(df, ["properties.title"]).first()[0] == "a"


def test_duplicates(spark):
    rows = [(0, "u", "1"), (1, "u", "1"), (2, "", "1"), (3, None, "1"), (4, "v", "2"), (5, " u ", "1")]
    df = spark.createDataFrame(rows, "rid int, url string, src string")
    report = keys.duplicate_report(df, ["url", "src"]).first().asDict()
    assert report == {"rows": 6, "unique_keys": 2, "empty_key_rows": 2, "duplicate_groups": 1, "duplicate_rows": 3, "removable_rows": 2}
    first = sorted(r["rid"] for r in keys.dedupe_keys(df, ["url", "src"], "rid").collect())
    last = sorted(r["rid"] for r in keys.dedupe_keys(df, ["url", "src"], "rid", "last").collect())
    assert first == [0, 2, 3, 4] and last == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        keys.dedupe_keys(df, ["nope"], "rid")


def test_joins(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b"), ("", "c"), ("3", "d")], "id string, name string")
    right = spark.createDataFrame([("1", "x", "n1"), ("1", "y", "n2"), ("", "z", "n3"), ("9", "w", "n4")], "uid string, tag string, name string")
    pairs = [("id", "uid")]
    card = keys.cardinality(left, right, pairs).first()
    assert (card["estimated_rows"], card["relation"], card["left_unusable_key_rows"], card["left_unmatched_rows"], card["right_unmatched_rows"]) == (2, "one-to-many", 1, 3, 2)
    sizes = {how: keys.join_tables(left, right, pairs, how).df.count() for how in ("inner", "left", "right", "outer")}
    assert sizes == {"inner": 2, "left": 5, "right": 4, "outer": 7}
    outer = {tuple(r) for r in keys.join_tables(left, right, pairs, "outer").df.collect()}
    assert ("9", "", "w", "n4") in outer and ("", "c", "", "") in outer and ("", "", "z", "n3") in outer
    filled = keys.join_tables(left, right, pairs, "right", coalesce=True).df
    assert filled.columns == ["id", "name", "tag"] and ("9", "n4", "w") in {tuple(r) for r in filled.collect()}
    with pytest.raises(ValueError, match="limit"):
        keys.join_tables(left, right, pairs, "left", max_rows=4)
    assert {r["name"] for r in keys.unmatched(left, right, pairs).collect()} == {"b", "c", "d"}


def test_profile(spark):
    rows = [("a", "1", ""), ("b", "2", " "), ("a", "3", None), ("c", "x", ""), ("a", "5", "")]
    df = spark.createDataFrame(rows, "kind string, year string, note string")
    found = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert (found["kind"]["distinct"], found["kind"]["kind"], found["year"]["kind"], found["note"]["kind"], found["note"]["empty"]) == (3, "text", "numeric", "empty", 5)
    assert [r["value"] for r in profile.top_values(df, 1).where("column = 'kind'").collect()] == ["a"]
    numbers = profile.numeric_summary(df).collect()
    assert [(r["column"], r["parsed"], r["median"], r["mean"]) for r in numbers] == [("year", 4, 2.5, 2.75)]


def test_page(table):
    out = review.page(table, "title", "X", ["kind"], 0, 1)
    assert out.df.columns == ["kind"] and out.df.count() == 1
    assert out.stats.first().asDict() == {"total": 4, "matched": 2}
    assert review.page(table, "title", "optik", ["kind"]).stats.first()["matched"] == 0
    with pytest.raises(ValueError):
        review.page(table, "title", "x", ["nope"])


def test_audit_predictions(spark):
    gold = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, []), (4, ["c"])], "row int, labels array<string>")
    ranked = "row int, ranked array<struct<uri:string,confidence:double>>"
    guesses = spark.createDataFrame([(1, [("x", 0.9), ("a", 0.05)]), (2, [("x", 0.95), ("y", 0.01)]), (3, [("x", 0.9)]), (4, [("x", 0.5)])], ranked)
    assert sorted(r["row"] for r in review.audit_predictions(gold, guesses).collect()) == [2, 3]
    assert review.update_status(spark.createDataFrame([(1, "passed")], "id int, status string"), spark.createDataFrame([(1, "rejected"), (7, "x")], "id int, new_status string")).collect()[0]["status"] == "rejected"
    assert F is not None
