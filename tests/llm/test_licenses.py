import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import catalog, licenses


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False)))


def compare(spark, docs):
    mine = licenses.scan(docs.select("doc_id", "text")).drop("text").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})))
    theirs = con.execute(licenses.oracle_sql()).df()[list(mine.columns)]
    for c in mine:
        if c not in ("base_labels", "labels"):
            mine[c], theirs[c] = mine[c].astype(float), theirs[c].astype(float)
    assert rows_of(mine) == rows_of(theirs)
    return mine


def test_odd_texts_equal_sql(spark):
    rng = random.Random(11)
    words = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["GNU", "cc", "by", "ë", "\n", "-", "CC"]
    texts = [None, "", "\n", "GNU General\nPublic License", "cc by cc by nc", "Released* under the MIT Licence!"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    texts += [t.upper() for _, t in licenses.TEMPLATES] + ["word " * 100_000 + licenses.TEMPLATES[3][1]]
    docs = spark.createDataFrame([*enumerate(texts), (None, "cc by"), (4, texts[4])], "doc_id bigint, text string")
    got = compare(spark, docs.withColumn("score", F.lit("clash")))
    assert (got.n_links > 0).sum() >= len(licenses.TEMPLATES)
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_given_table_equals_sql(spark):
    got = compare(spark, spark.read.parquet(str(TESTDATA / "documents.parquet")))
    assert got.labels.str.contains("cc-by-nc").any()
    assert set(catalog.QUERIES) >= {"op8_license_scan"}
    assert re.search("GROUP BY", catalog.ORACLES["op8_license_scan"])
