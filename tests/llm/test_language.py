import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import language


def slow_trigrams(text):
    out, last = {}, "\0"
    letters = "\0"
    for c in text.lower() + "\0":
        c = c if c.isalpha() else "\0"
        if c != "\0" or last != "\0":
            letters += c
        last = c
    for i in range(len(letters) - 2):
        key = ord(letters[i]) << 42 | ord(letters[i + 1]) << 21 | ord(letters[i + 2])
        out[key] = out.get(key, 0) + 1
    return out


def test_trigrams_equal_plain_loop(monkeypatch):
    rng = random.Random(4)
    for piece in (language._PIECE, 7):
        monkeypatch.setattr(language, "_PIECE", piece)
        for text in ("", " ", "a", "ab!", "Ünïcode 日本 x", "".join(rng.choice("abé 1\n") for _ in range(300))):
            codes, counts = language.trigrams(text.encode())
            assert dict(zip(codes.tolist(), counts.tolist())) == slow_trigrams(text)


def test_bundle_is_the_sum_of_bound_vectors():
    table = language._Table(64, most=5)
    codes, counts = language.trigrams(b"the cat and the hat")
    want = np.zeros(64)
    for c, n in zip(codes.tolist(), counts.tolist()):
        a, b, d = (table.letter(c >> s & 0x1FFFFF).astype(int) for s in (42, 21, 0))
        want += n * np.roll(a, 2) * np.roll(b, 1) * d
    small = language._Table(64, most=1000)
    assert np.array_equal(small.bundle(codes, counts), want)
    assert np.array_equal(small.bundle(codes, counts), want)


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(12)]
    rows += [(20 + i, "der hund und die katze " * 3, "de") for i in range(12)]
    rows += [(50, None, "en"), (51, "123 !", "en"), (52, "", None), (None, "the cat", None), (53, "x " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "en" and got[20 + i].lang_pred == "de" for i in range(12))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (50, 51, 52))
    assert got[None].held_out and got[None].lang_pred == "en"
    assert language.predict_languages(docs.limit(0)).count() == 0
    untaught = language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} & {50, 51, 52} == set()


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(TESTDATA / "documents.parquet"))
    got = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.97
