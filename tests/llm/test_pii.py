import hashlib
import random
import re

from pyspark.sql import functions as F

from isobar.llm import catalog, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def right(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def slow(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text or "") if right(kind, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "mail a.b@c.de, a@b@c.org x_@y.z.w. 😀 q@r.st_d@e.fg", "1.2.3.4.5.6.7.8 999.1.1.1 010.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +49 (0) 12 +1 +2 333 444 55 66 7-",
    "1" * 5000 + " a@" + "b." * 3000 + "c", "x" * 50_000 + "@", "5 " * 9 + "4111111111111111",
]


def test_exact_spans_equal_plain_loop(spark):
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice("01a.@+- (é😀") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    text = F.coalesce("text", F.lit(""))
    got = {r.id: r.s for r in docs.select("id", pii.span_text(pii.exact_spans(text)).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == slow(t), t


def test_query_columns_and_added_spans(spark, tmp_path):
    rng = random.Random(10)
    words = ["tea", "run", "over", "blue", "inside"]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(20))
        if i % 3 == 0:
            text += f' token = "{hexes(40)}" end'
        if i % 5 == 0:
            text += f" call +1 (555) 01{i:03d}-7713 now, from 10.0.{i % 250}.7"
        if i % 7 == 0:
            text += f" part number {i:07d} of lot"
        rows.append((i, text))
    rows += [(300 + i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.cd"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op9_pii"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k + ":") for k in PATTERNS]
        spans = set(filter(None, r.spans.split(",")))
        assert set(filter(None, base.split(","))) <= spans
        assert any(s.startswith("secret:") for s in spans) == (r.doc_id is not None and r.doc_id < 300 and r.doc_id % 3 == 0)
    assert pii.find(docs.limit(0)).count() == 0


def test_thresholds_come_from_all_candidates(spark):
    text = "concat('call +1 (555) 01', lpad(id, 5, '0'), '-7713 part number ', lpad(id, 7, '0'), if(id % 400 = 7, concat(' token = \"', left(sha2(string(id), 256), 40), '\" end'), ''))"
    docs = spark.range(2000).selectExpr("id AS doc_id", f"{text} AS text")
    exact = docs.select("doc_id", "text", pii.exact_spans(F.col("text")).alias("exact"))
    found = exact.select("doc_id", pii._candidates(F.col("text"), F.col("exact")).alias("candidates")).cache()
    assert pii.SECRET in pii.fit(found, sample=200).thresholds
