import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import urls


def check(spark, rows, rules=urls.RULES):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    mine = urls.judge(pages, rules).toPandas().astype({"page_id": "Int64"})
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con.register("pages", frame.astype({"page_id": "Int64", "url": "string", "html": "string"}))
    theirs = con.execute(urls.oracle_sql(rules)).df()
    key = lambda f: sorted(tuple(map(str, r)) for r in f[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(lambda x: x.notna(), "-").itertuples(index=False))
    assert key(mine) == key(theirs)
    return {r.url: r for r in mine.merge(frame[["page_id", "url"]], on="page_id").itertuples()}


def test_rules_and_odd_urls(spark):
    rows = [(i, u, None) for i, u in enumerate([
        "http://A.Example.NET/en/x?y=/de/", "http://example.net/de/", "https://x.net", "ftp://net/a#b", "http://notexample.com/de/",
        "http://example.com/de/1", "http://example.com/de", "http://b.org/fr/?q", "no scheme", None, "", "x://", "http://h?q/fr/",
        "http://planet/", "a://b://c.net/",
    ])] + [(None, "http://q.net/", ""), (0, "http://A.Example.NET/en/x?y=/de/", "")]
    got = check(spark, rows)
    assert got["http://A.Example.NET/en/x?y=/de/"].rule == "example.net/en/"
    assert got["https://x.net"].rule != got["https://x.net"].rule or got["https://x.net"].rule is None
    assert got["ftp://net/a#b"].verdict == "block" and got["http://planet/"].verdict == "allow"
    assert got["http://h?q/fr/"].path == ""
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert urls.judge(pages.limit(0)).count() == 0


def link(*hosts):
    return "".join(f"<a HREF='//{h}/x'>x</a> <a href=/own>y</a>" for h in hosts)


def test_distrust_goes_back_and_trust_forward(spark):
    rules = (("bad.io/", "block"), ("good.io/", "allow"))
    rows = [
        (1, "http://bad.io/a", link("far.io")), (2, "http://good.io/a", link("kept.io", "both.io")),
        (3, "http://farm.io/", link("bad.io", "kept.io")), (4, "http://farm.io/2", link("BAD.io")),
        (5, "http://feeds.io/", link("farm.io")), (6, "http://kept.io/", None), (7, "http://far.io/", ""),
        (8, "http://both.io/", link("bad.io", "kept.io", "good.io")), (9, "http://alone.io/", "x" * 300_000),
    ]
    got = {u[7:]: r.verdict for u, r in check(spark, rows, rules).items()}
    assert got["farm.io/"] == got["feeds.io/"] == got["bad.io/a"] == "block"
    assert got["kept.io/"] == got["far.io/"] == got["alone.io/"] == got["good.io/a"] == "allow"


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(TESTDATA / "pages.parquet")).select("page_id", "url", "html").collect()]
    check(spark, rows)
