import random

import numpy as np
from pyspark.sql import functions as F

from isobar.llm import pieces


def slow(coder, vocabulary, text):
    """Plain Viterbi: every start tried at every place, longest piece first."""
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    longest = max(map(len, table))
    text = " " + text if text else ""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            i, s = table.get(text[start:end], (None, None))
            if i is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, (start, [i])
        if text[end - 1] not in table and best[end - 1] + coder.low > best[end]:
            best[end], back[end] = best[end - 1] + coder.low, (end - 1, [coder.bytes[b] for b in text[end - 1].encode()])
    ids, at = [], len(text)
    while at:
        at, own = back[at]
        ids = own + ids
    return ids


TEXTS = ["", " ", "  two  spaces ", "a\nb\n\n c", "naïve ▁mark▁", "日本語 text 😀", "\t\x00", "THE END.", "   " * 30]


def test_encoding_equals_plain_viterbi_and_round_trips():
    vocabulary = pieces.load()
    coder = pieces.Coder(vocabulary)
    rng = random.Random(12)
    texts = TEXTS + ["".join(rng.choice("the an.é \n日") for _ in range(rng.randint(1, 120))) for _ in range(150)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == slow(coder, vocabulary, text), repr(text)
        assert coder.decode(ids) == text


def test_small_vocabulary_follows_output_links():
    parts = [(" ", 0, -1.0), ("a", 1, -5.0), ("b", 2, -5.0), ("ab", 3, -7.0), ("bab", 4, -8.0), (" abab", 5, -30.0)]
    coder = pieces.Coder(pieces.Vocabulary(parts, list(range(10, 266)), 9, 266))
    assert coder.encode("abab") == [0, 1, 4]
    assert coder.encode("ab") == [0, 3]
    assert coder.encode("c") == [0, 10 + ord("c")]


def test_odd_rows(spark):
    texts = [*TEXTS, None, "x" * 20_000, "word " * 30_000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    coded = pieces.encode(docs)
    rows = coded.collect()
    assert len(rows) == len(texts) + 1 and all(r.exact for r in rows)
    by_id = {r.doc_id: r for r in rows}
    null = len(TEXTS)
    assert by_id[null].ids is None and by_id[null].n_tokens == 0 and by_id[0].ids == []
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    assert pieces.encode(docs.limit(0)).count() == 0
