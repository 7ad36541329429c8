from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import catalog, negatives

SCHEMA = "vec_id bigint, embedding array<float>, label bigint"


def brute(rows, every=10, positives=5, count=10, scale=256):
    known = {
        (i, label, tuple(floor(scale * x) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    }
    out = []
    for i, label, v in known:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in known if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(n[:2] for n in scored if n[2] != label and 30 * -s <= 100 * -n[0] <= 90 * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit[:count], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    made = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    return sorted(map(tuple, made.collect()))


def random_rows(n, dim, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    values = np.float32(rng.normal(0.1, spread, (n, dim)))
    return [(i, [float(x) for x in v], int(rng.integers(3))) for i, v in enumerate(values)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = random_rows(150, 7)
    rows += rows[:20] + [(i + 200, rows[5][1], rows[5][2]) for i in range(30)] + [(i + 300, rows[5][1], 9) for i in range(30)]
    rows += [
        (400, None, 1), (410, [1.0, None], 1), (420, [float("nan")], 1), (430, [float("inf")], 1), (440, [1.0], None),
        (None, [1.0] * 7, 1), (450, [], 1), (460, [0.5], 2), (470, [0.25] * 12, 1), (480, [0.0] * 7, 1), (10, [0.5] * 7, 2),
        (-10, [-0.5] * 7, 0), (490, [1.0] * 7, -3), (500, [300.0] * 7, 1),
    ]
    want = brute(rows)
    assert len(want) > 500 and mined(spark, rows) == want


def test_blocks_and_stripes_change_nothing(spark, monkeypatch):
    rows = random_rows(400, 5, seed=2)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(negatives, "TILE", (7, 50))
    assert mined(spark, rows) == brute(rows)


def test_large_scores_and_many_components(spark):
    rows = random_rows(40, 1500, seed=3, spread=1000.0)
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="smaller scale"):
        mined(spark, [(0, [1e30], 1)])


@pytest.mark.parametrize(("bound", "dim"), [(10, 1), (10**6, 128), (10**9, 1024), (10**16, 3000)])
def test_residues_give_exact_scores(bound, dim):
    residues = negatives.Residues(bound, dim)
    rng = np.random.default_rng(dim)
    most = int((bound / dim) ** 0.5)
    a, b = (rng.integers(-most, most + 1, (40, dim)) for _ in range(2))
    a[0], b[0], b[1] = most, most, -most
    assert (residues.scores(residues.of(a), residues.of(b)) == a @ b.T).all()


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    rows = random_rows(60, 4, seed=5)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS key", "2 AS v", "3 AS wide", "4 AS cell", "5 AS kind", "6 AS near", "7 AS dim", "8 AS norm", "9 AS rank"
    )
    assert sorted(map(tuple, negatives.hard_negatives(wide, F.col("vec_id") % 10 == 0).collect())) == brute(rows)


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_query_equals_sql(spark):
    mine = catalog.QUERIES["op11_hard_negatives"](spark, str(TESTDATA)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TESTDATA}/embeddings.parquet'")
    theirs = con.execute(catalog.ORACLES["op11_hard_negatives"]).df()[list(mine.columns)]
    assert len(mine) and sorted(map(str, mine.itertuples(index=False))) == sorted(map(str, theirs.itertuples(index=False)))
