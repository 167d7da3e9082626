"""Every query that has a statement gives its rows, on the smallest tables; the entry works without optional parts."""

import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from rowforge.functions import text as tx
from rowforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [q for q in catalog.oracle_sql() if not q.startswith(("str", "flt", "jn2", "val", "col"))]


def rows(values):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        return str(None if v != v else round(v, 6) if isinstance(v, float) else v)

    return sorted(tuple(plain(v) for v in r) for r in values)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_statement(spark, engine, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = engine.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = rows([r[i] for i in order] for r in found.fetchall())
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry_without_the_optional_parts(spark, monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("rowforge.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "rowforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert "pipeline" not in entry.queries() and "op1_byte_bpe" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_references_that_the_statement_leaves_as_written(spark, tmp_path):
    """txt1_references decodes four closed references; whatever else begins with an ampersand stays, as in its statement."""
    pages = [
        "token = &quot <b>p</b>", "&quo; &quo", "&copy2 &middotx &copy", "&copy; &middot; &quot; &amp;", "&amp;quot; &amp;amp;copy;", "&&copy;& &",
        "&lt;b&gt; &nbsp; &#39; &#x27;", "x &notit; &QUOT; &COPY;", "a&a&copy;mp;", "&amp &quot;", "&am\n", "<i>none</i>", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["txt1_references"]).fetchall()
    df = catalog.queries()["txt1_references"](spark, str(tmp_path))
    assert rows(df.collect()) == rows(want) and len(want) == 10
    assert dict(want)[0] == "token = &quot p"
    # The function itself decodes whatever HTML does.
    assert spark.createDataFrame([("&quot &lt &#39;",)], "t string").select(tx.clean_text(F.col("t"))).first()[0] == "\" < '"
