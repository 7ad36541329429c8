import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import lines


def slow(spark, rows):
    """Every line against every line before it."""
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = sorted({(r.kid, r.th, r._text) for r in lines._keyed(frame).collect()}, key=lambda r: r[:2])
    seen, by_size, gone = set(), {}, {}
    for kid, th, text in keyed:
        for n, line in enumerate((text or "").split("\n")):
            low = line.translate({c: c + 32 for c in range(65, 91)})
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", low))
            if not words:
                continue
            near = words in seen or any(
                len(words & w) / len(words | w) >= 0.8
                for m in range(int(len(words) * 0.8), int(len(words) / 0.8) + 2)
                for w in by_size.get(m, ())
            )
            if near:
                gone.setdefault((kid, th), []).append(n)
            if words not in seen:
                seen.add(words)
                by_size.setdefault(len(words), []).append(words)
    return gone


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit("clash"))
    got = {(r.kid, r.th): r.removed for r in lines.removed_lines(docs).collect()}
    assert got == slow(spark, rows)
    return docs


def some_rows(rng, n=60):
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(3000)]
    stock = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(stock)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            text.append(" ".join(words))
        rows.append((i, "\n".join(text)))
    return rows


def test_equals_all_pairs(spark):
    rng = random.Random(13)
    rows = some_rows(rng) + [(3, "a b"), (None, "a b"), (70, None), (71, ""), (72, "\n \n"), (5, "a b"), (5, "a b")]
    # One id for several texts, with lines that match each other.
    rows += [(5, "q1 q2 q3 q4 q5 q6\nz"), (5, "q1 q2 q3 q4 q5 q6 q7\nz z"), (5, "q1 q2 q3 q4 q5 q6 q8 q7")]
    docs = check(spark, rows)
    report = {(r.doc_id, r.n_lines): r for r in lines.line_report(docs).collect()}
    assert report[70, 0].n_removed == 0 and report[71, 1].n_removed == 0 and report[72, 3].n_removed == 0
    assert report[None, 1].n_removed == 0
    assert lines.removed_lines(docs.limit(0)).count() == 0


def test_large_family_and_long_lists(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(120):
        i = i - 1 if i % 10 == 0 and i else i  # some ids stand for two texts
        words = list(base)
        words[rng.randrange(30)] = f"new{rng.random()}"
        if i % 7 == 0:  # shares rare words with the family but does not match it
            words = base[:6] + [f"own{i}_{k}" for k in range(20)]
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(lines, "NEAR", 4)
    monkeypatch.setattr(lines, "FIRST", 2)
    check(spark, rows)


def test_pairs_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(15)
    rows = sorted((rng.randint(0, 6), i) for i in range(400))
    columns = {"token": [r[0] for r in rows], "kid": [r[1] for r in rows]}
    columns |= {c: [0] * 400 for c in ("line", "pos", "prev")} | {"size": [10] * 400}
    columns["bits"] = [rng.choice([0, 0, -1]) for _ in rows]
    types = {c: pa.int32() for c in ("token", "line", "size", "pos", "prev")}
    batch = pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.int64())) for c in lines._POSTING], names=lines._POSTING)
    monkeypatch.setattr(lines, "NEAR", 20)
    seen = set()
    for size in (400, 150, 64, 7, 1):
        parts = [batch.slice(i, size) for i in range(0, 400, size)]
        out = [r for b in lines._near_candidates(iter(parts)) for r in b.to_pylist()]
        pairs = [(r["kid"], r["y_kid"]) for r in out if r["token"] is None]
        marks = [(r["kid"], r["token"]) for r in out if r["token"] is not None]
        assert len(set(pairs)) == len(pairs) and len(set(marks)) == len(marks)
        seen.add((frozenset(pairs), frozenset(marks)))
    assert len(seen) == 1


def test_texts_lose_their_lines(spark):
    long_line = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "one two three four five\nkeep me"), (2, "x\none two three four FIVE\n\ny"), (3, "x"), (4, long_line), (5, long_line + " z"), (6, None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert got[1].text == rows[0][1] and got[1].n_chars == 9
    assert got[2].text == "x\n\ny" and got[2].n_chars == 4
    assert got[3].text == "" and got[5].text == "" and got[6].text is None and got[4].text == long_line


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_given_table_equals_all_pairs(spark):
    docs = spark.read.parquet(str(TESTDATA / "documents.parquet"))
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def family(rng, n=60, size=100):
    """Long lines of which many share most words, some of them too few."""
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.choice([3, 9, 12, 14])):
            words[at] = f"new{i}_{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_many_partners_are_found_without_second_words(spark, monkeypatch):
    """Lists of usual length are gone through again, not spread over pairs of words."""
    monkeypatch.setattr(lines, "FIRST", 2)
    asked = []
    again = lines._near_candidates
    monkeypatch.setattr(lines, "partial", lambda f, **more: asked.append(f) or (lambda batches: again(batches, **more)), raising=False)
    monkeypatch.setattr(lines.F, "explode", lambda column: pytest.fail("a list was spread by its second words"))
    check(spark, family(random.Random(16)))
    assert asked


def test_report_shuffles_no_text_and_shuffles_end(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, during, stored = spark.conf.get(name), [], lines._stored
    monkeypatch.setattr(lines, "_stored", lambda df: during.append(spark.conf.get(name)) or stored(df))
    docs = spark.createDataFrame([(1, "a b c d\ne"), (2, "a b c d")], "doc_id bigint, text string")
    report = lines.line_report(docs)
    assert set(during) == {"true"} and spark.conf.get(name) == before
    node = report._jdf.queryExecution().optimizedPlan()
    while not node.nodeName().startswith("Join"):
        node = node.children().head()
    assert "n_lines" in node.children().head().output().mkString(",") and "text" not in node.children().head().output().mkString(",")
    assert sorted(map(tuple, report.collect())) == [(1, 2, 0, ""), (2, 1, 1, "0")]


def test_words_are_found_and_hashed_at_any_place():
    """A word has one hash, whatever its case, length and neighbours; texts part words."""
    rng = random.Random(17)
    words = ["a" * n + tail for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for tail in ("x", "y", "\0", "é")]
    texts = ["", "ab", "AB\tab", " ", "ab\x0bab\n"] + [" ".join(rng.choice([w, w.upper()]) for w in rng.sample(words, 9)) for _ in range(60)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends = lines._word_places(data, offsets)
    expected = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    assert [data[i:j] for i, j in zip(starts, ends, strict=True)] == expected
    low = [w.translate(lines._LOWER) for w in expected]
    hashes = lines._word_hashes(data, starts, ends).tolist()
    assert len(set(zip(low, hashes, strict=True))) == len(set(low)) == len(set(hashes))


def test_report_reads_texts_for_lines_only(spark):
    """Rows come from the stored lines: ids that are null, negative, large or doubled, and null texts too."""
    big = 2**40
    rows = [(None, "a b"), (-(2**63), "a b"), (-5, "a b"), (big, "p q r s t u\n\nz"), (big + 1, "p q r s t u v"), (big, None), (7, "\n"), (7, "\n"), (-5, "A b\na b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    report = lines.line_report(docs)
    assert "documents" not in report._jdf.queryExecution().optimizedPlan().toString() and not report._jdf.queryExecution().optimizedPlan().toString().count("text#")
    got = Counter((r.doc_id, r.n_lines) for r in report.collect())
    assert got == Counter((i, 0 if t is None else t.count("\n") + 1) for i, t in rows)
    check(spark, rows)


def test_copies_are_added_up_before_the_exchange(spark):
    """Of equal lines that stand together one row goes on, and it tells how many they are."""
    docs = spark.createDataFrame([(i, "one two three four\nfour three TWO one one") for i in (4, 2, 9)], "doc_id bigint, text string").coalesce(1)
    sets = lines.line_sets(docs, lines.word_ranks(docs)).where("line >= 0").collect()
    assert sorted((r.kid, r.line, r.times) for r in sets) == [(2, 0, 6), (2, 1, 0), (4, 0, 0), (4, 1, 0), (9, 0, 0), (9, 1, 0)]


def test_batches_of_lists_are_not_added_up_row_by_row(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, during, make = spark.conf.get(name, None), [], lines._sorted_lists
    monkeypatch.setattr(lines, "_sorted_lists", lambda postings: during.append(spark.conf.get(name)) or make(postings))
    lines.removed_lines(spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "doc_id bigint, text string"))
    assert during == [str(2**31 - 1)] and spark.conf.get(name, None) == before
