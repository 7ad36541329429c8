import random
from itertools import combinations

import numpy as np
import xxhash

from isobar.llm import simhash
from pyspark.sql import functions as F


def slow_fingerprint(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    n = max(1, len(words) - 3)
    shingles = [b" ".join(words[i : i + 4]) for i in range(n)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if words else 0


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= simhash.RADIUS:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_equals_plain_loop():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60, 500):
        text = " \n".join(rng.choice(["Über", "A", "bc", "ÉT", "x y"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_bit_sliced_pairs_equal_popcount():
    rng = np.random.default_rng(2)
    for sizes in ([2], [3, 70, 2, 200, 1], [300]):
        fps = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64) & np.uint64(0xFFF)
        ends = np.cumsum([0, *sizes])
        got = {(i, j) for a, b in simhash.near_pairs(fps, ends, 4) for i, j in zip(a.tolist(), b.tolist())}
        want = {
            (i, j)
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())
            for i in range(s, e)
            for j in range(i + 1, e)
            if int(fps[i] ^ fps[j]).bit_count() <= 4
        }
        assert got == want


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(4)]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a, b in combinations(range(40), 2)]  # a hot bucket
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = simhash.components(simhash.links(frame, cell=64)).collect()
    root = {r.node: r.root for r in got}
    want = slow_components(fps)
    groups = lambda m: {frozenset(g) for g in _groups(m).values() if len(g) > 1}
    assert groups(root) == groups(dict(zip(signed, [want[f] for f in fps])))


def _groups(roots):
    out = {}
    for node, root in roots.items():
        out.setdefault(root, set()).add(node)
    return out


def test_near_duplicates_and_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(4000))
    rows = [
        (5, "a b c d e f"), (3, "A b  c d e f"), (9, None), (8, ""), (8, ""), (1, long_text),
        (2, long_text.replace("w77 ", "zz ")), (None, "lonely words in a row here"), (7, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = slow_components([slow_fingerprint(t or "") for _, t in rows])
    ids = {}
    for i, t in rows:
        if i is not None:
            r = want[slow_fingerprint(t or "")]
            ids[r] = min(ids.get(r, i), i)
    for r in got:
        fp = r.fp % 2**64
        assert r.component_id == ids.get(want[fp])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    lonely = 1  # the group that has no id
    assert sorted(i for i in got if i is not None) == sorted(ids.values()) and got.count(None) == lonely
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_the_first_of_each_component(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        near = list(words)
        near[rng.randrange(400)] = "changed"
        texts += [" ".join(words), " ".join(near), " ".join(words[:200])]
    prints = [slow_fingerprint(t) for t in texts]
    root = slow_components(prints)
    want = {}
    for i, fp in enumerate(prints):
        want.setdefault(root[fp], i)
    assert 40 < len(want) < 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(want.values())
