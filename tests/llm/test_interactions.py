from itertools import permutations

import duckdb
import numpy as np
import pytest

from conftest import TESTDATA
from isobar.llm import catalog, interactions

LONG = " ".join(f"w{i}" for i in range(200))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (3, "Aa $", None), (4, "", ""), (5, None, "en"), (6, "a a a", "en"),
    (7, LONG + " x", "en"), (None, LONG, "en"), (None, "z", "en"), (8, "z", "en"), (9, LONG.upper(), "de"), (9, "B", "en"),
    (10, " \t\n", "en"), (11, " " * 3, "en"), (12, "\U0001f600 " * 200, "de"), (-1, "a a a", "de"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    return documents, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def fails(doc, docs):
    number, text = doc[0], doc[1] or ""
    words = text.translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": number is not None and any((d[1] or "") == text and d[0] is not None and d[0] < number for d in docs),
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = [(d[0], d[2] or "", fails(d, docs)) for d in docs]
    out = []
    for part in {k[1] for k in known}:
        mine = [k for k in known if k[1] == part]
        rows = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if k[2][f]]
                left = [k for k in left if not k[2][f]]
                failing = [k for k in mine if k[2][f]]
                alone = sum(sum(k[2].values()) == 1 for k in failing)
                lost = sum(k[0] in good for k in gone), sum(k[0] in toxic for k in gone)
                rows.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), alone, *lost))
        total = {f: sum(r[4] for r in rows if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_equals_every_order_filter_by_filter(spark):
    docs, labels = frames(spark)
    got = sorted(map(tuple, interactions.filter_interactions(docs, labels).collect()))
    assert got == brute(DOCS, LABELS)


def test_walk_equals_counting_each_set():
    cells = np.random.default_rng(3).integers(0, 50, (32, 3))
    left = interactions.survivors(cells)
    for active in range(32):
        assert (left[active] == cells[[m for m in range(32) if not m & active]].sum(axis=0)).all()


def test_other_filters_and_their_number(spark):
    docs, labels = frames(spark)
    only = {"L": lambda text, found: interactions.F.length(text) > 10}
    got = {(r.part, r.filter_order, r.step): r.removed for r in interactions.filter_interactions(docs, labels, only).collect()}
    assert len(got) == 3 * 2 * 2 and got["de", "LE", 1] == 4 and got["de", "EL", 1] == 2


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = frames(spark)
    assert interactions.filter_interactions(docs.limit(0), labels).collect() == []
    want = brute(DOCS, [])
    wide = docs.selectExpr("*", "1 AS mask", "2 AS part", "3 AS n", "4 AS digest", "5 AS good", "6 AS found", "7 AS first")
    assert sorted(map(tuple, interactions.filter_interactions(wide, labels.limit(0)).collect())) == want


def test_texts_are_not_shuffled(spark):
    docs, labels = frames(spark)
    plan = interactions.filter_interactions(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_query_equals_sql(spark):
    mine = catalog.QUERIES["op12_filter_audit"](spark, str(TESTDATA)).toPandas()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    theirs = con.execute(catalog.ORACLES["op12_filter_audit"]).df()[list(mine.columns)]
    assert sorted(map(str, mine.itertuples(index=False))) == sorted(map(str, theirs.itertuples(index=False)))
