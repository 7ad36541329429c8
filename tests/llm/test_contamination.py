import re

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import contamination as c

ITEMS = [
    (1, "A train goes 120 km from Paris to Rome in 3 hours. How fast was the train on its way?"),
    (2, "Was it the red fox that ran over the old grey stone wall at night again?"),
    (3, None), (None, "some words that nobody has numbered at all"), (4, "too short"), (5, ""),
]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("win", F.lit("clash"))
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("pos", F.lit("clash"))
    return {(r.doc_id, r.item_id) for r in c.contaminated(docs, frame).collect()}, docs, frame


def test_reparameterised_and_consistent(spark):
    texts = [
        "Well. A train goes 95.5 miles from Oslo to Kiel in 7 hours. How fast was the train on its way? Yes.",
        "A train goes 120 km from Paris to Rome in 3 hours. How fast was the train on its way?",
        "A TRAIN GOES 1 KM FROM PARIS TO ROME IN 3 HOURS. HOW FAST WAS THE TRAIN ON ITS WAY?",
        "A train is fast. How fast was the train? From Paris to Rome in 3 hours.",
        "WAS it the red fox that ran over the old grey stone wall at night again?",
        "x " * 100_000 + "was it the red fox that ran over the old grey stone wall at night again",
        None, "", "too short",
    ]
    got, docs, items = found(spark, texts)
    assert {(0, 1), (1, 1), (4, 2), (5, 2)} <= got and not {d for d, _ in got} & {3, 6, 7, 8}
    kept = c.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(9)) - {d for d, _ in got}
    assert c.contaminated(docs.limit(0), items).count() == 0
    assert c.contaminated(docs, items.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "take 4 apples and then put 4 pears with the 4 plums so that all of 4 boxes hold 4 things"
    same = item.replace("4", "9")
    mixed = "take 1 apples and then put 2 pears with the 3 plums so that all of 5 boxes hold 6 things"
    got, _, _ = found(spark, [same, mixed], [(1, item)])
    assert got == {(0, 1)}


def test_each_occurrence_settles_its_own_values(spark):
    one = "A train goes {} {} from {} to {} in {} hours. How fast was the train on its way?"
    copies = [("120", "km", "Paris", "Rome", "3")] + [(str(95 + i), "miles", f"Oslo{i}", f"Kiel{i}", str(7 + i)) for i in range(6)]
    texts = [" Well. ".join(one.format(*c) for c in some) for some in (copies[:2], copies, copies[::-1], copies[1:3])]
    # A part of each of two variants is not an occurrence of the item.
    texts.append("A train goes 1 km from Oslo to Kiel in 2 hours.")
    got, _, _ = found(spark, texts)
    assert got == {(i, 1) for i in range(4)}


def test_case_line_breaks_and_short_items(spark):
    text = ITEMS[0][1]
    texts = [
        text.upper(), text.lower(), text.replace("from Paris", "from\nParis").replace("to Rome", "to\nRome"),
        "so then\nCount the red apples again now", "we should Count the red apples again now", "COUNT RED APPLES NOW",
        "count red apples", "A TRAIN IS FAST FROM PARIS TO ROME",
    ]
    items = [(1, text), (7, "Count the red apples again now"), (8, "Count red apples now"), (4, "too short")]
    got, _, _ = found(spark, texts, items)
    assert got == {(0, 1), (1, 1), (2, 1), (3, 7), (4, 7), (5, 8)}


def plain_windows(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_given_tables_against_plain_windows(spark):
    folder = str(TESTDATA).replace("sf0.001", "sf0.01")
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in c.contaminated(docs, items).collect()}
    texts = {r.doc_id: plain_windows(r.text) for r in docs.collect()}
    want = set()
    for r in items.collect():
        own = plain_windows(r.text)
        want |= {(d, r.item_id) for d, w in texts.items() if own and len(own & w) >= 0.9 * len(own)}
    assert want and want <= got
    assert len(got) <= len(want) + 3
