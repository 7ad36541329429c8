import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import quality
from isobar.llm.sampling import smallest


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    marked = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)]


TEXTS = ["", "a", "a b c a b c a", "x\n\nx\n \nx y\nx", "é# é# é# é#\n", "\n\n", "a\x1cb\x85c d", None]


def test_statistics_equal_plain_loop(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é\n|") for _ in range(rng.randint(0, 400))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["one two three", "ü", "four"]) for _ in range(30)), "w " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: list(r)[1:6] for r in quality.rule_statistics(docs, "text", "doc_id").collect()}
    assert got == {i: slow(t or "") for i, t in enumerate(texts)}


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(6)
    rows = np.concatenate((rng.normal(size=(500, 3)), rng.normal(6, 1, size=(20, 3))))
    scores = quality.grow(rows, trees=50).score(rows)
    assert scores[500:].min() > np.quantile(scores[:500], 0.9)
    good = np.arange(520) < 500
    border = quality.calibrate(scores, good, 0.99)
    assert (scores[:500] <= border).mean() >= 0.99
    assert quality.calibrate(scores, np.ones(520, bool)) == float("inf")
    same = quality.grow(np.ones((10, 3))).score(np.ones((4, 3)))
    assert len(set(same.tolist())) == 1


def test_threshold_from_all_rows(spark):
    rng = np.random.default_rng(9)
    scores = np.concatenate((rng.beta(2, 8, 5000), rng.beta(8, 3, 400)))
    good = np.arange(5400) < 5000
    rows = [(float(x), bool(g), 1 + i % 3) for i, (x, g) in enumerate(zip(scores, good))]
    scored = spark.createDataFrame(rows, "anomaly double, good boolean, rows bigint").repartition(7)
    times = np.array([r[2] for r in rows])
    wide = np.repeat(scores, times), np.repeat(good, times)
    exact = quality.calibrate(*wide)
    assert exact == quality.calibrate(scores, good, times=times)
    border = np.quantile(wide[0][wide[1]], quality.KEPT_GOOD, method="higher")
    assert exact > border and not ((wide[0] > border) & (wide[0] <= exact) & ~wide[1]).any()
    assert abs(quality.threshold_of(scored) - exact) <= 2 / quality.STEPS
    assert quality.threshold_of(scored.where("good")) == float("inf")
    assert quality.threshold_of(scored.limit(0)) == float("inf")


def test_sample_is_the_smallest_hashes(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("mark")).union(spark.range(9).select(F.lit(0).alias("mark")))
    marks = sorted(r.mark % 2**64 for r in rows.collect())
    for sample in (1, 9, 100, 4999, 6000):
        got = sorted(r.mark % 2**64 for r in smallest(rows, "mark", sample).collect())
        assert got == marks[: len(got)] and min(sample, len(marks)) <= len(got) <= max(sample + 9, 9)


def test_path_lengths_equal_a_walk():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(60, 2))
    forest = quality.grow(rows, trees=5, tree_rows=32)
    for row, score in zip(rows, forest.score(rows)):
        paths = []
        for t in range(5):
            node = 0
            while forest.left[t, node] != node:
                low = row[forest.feature[t, node]] < forest.cut[t, node]
                node = (forest.left if low else forest.right)[t, node]
            paths.append(forest.path[t, node])
        assert np.isclose(score, 2 ** (-np.mean(paths) / forest.usual))


def test_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a " * 60), (0, "")], "doc_id bigint, text string")
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.judge(docs, none).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(0, None), (None, 1), (2, 1), (2, 0)], "doc_id bigint, quality int")
    assert quality.judge(docs, odd).count() == len(got)


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_held_out_rows(spark):
    folder = str(TESTDATA).replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fit, ask = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.judge(docs, fit).join(ask, "doc_id").where("NOT base_failed").toPandas()
    good = got[got.quality == 1]
    assert good.kept.mean() >= 0.98
    assert (~got[got.quality == 0].kept).mean() >= 0.8
