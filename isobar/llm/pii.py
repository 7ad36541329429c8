"""Personal data: exact patterns, and boosted trees over further candidates; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints
from .sampling import smallest

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Candidates, at most, that the trees and thresholds are fitted on.
SAMPLE = 20_000
#: Share of accepted held-out candidates that must be right.
PRECISION = 0.95

# Possessive repeats match what greedy ones do here, as what follows is outside the
# repeated class, and neither go back nor nest calls in long texts.  Looking behind
# saves trying every place of a run; a match may also begin where the last one ended.
_EXACT = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    EMAIL: r"(?<![^\s@,;<>()\"'])[^\s@,;<>()\"']++(?:@|\(at\))[^\s@,;<>()\"']++",
    IP: r"(?<![0-9])[0-9]{1,4}(?:[.:][0-9]{1,4}){3,7}+",
    PHONE: r"\+?[0-9](?:[\x20().:-]{0,2}[0-9]){6,}+",
    SECRET: r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])[A-Za-z0-9_+/=-]{20,}+",
}
#: Cheap tests that every text with a match passes.
_GUARDS = {EMAIL: r"@", IP: r"[0-9][.:][0-9]", CARD: r"[0-9](?:[\x20-]?[0-9]){13}", PHONE: r"\+[0-9]"}
_LOOSE_GUARDS = {EMAIL: r"@", IP: r"[0-9][.:][0-9]", PHONE: r"[0-9][\x20().:0-9-]{0,2}[0-9]", SECRET: r"[0-9]"}

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUE = r"(?i)(?:mail|phone|tel|call|fax|card|visa|address|host|server|token|key|secret|passw|login|user)"
_ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d)\s*[=:]\s*[\"']?$"

FEATURES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "upper", "marks", "dots", "hex", "plus",
    "after_word", "before_word", "quoted", "cue",
)
_CANDIDATE = "array<struct<s:int,k:int,e:int,y:boolean,f:array<double>>>"


def _placed(text: Column, pattern: str, guard: str) -> Column:
    """``s`` (code points before it) and ``m`` of every match, first to last."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")
    )
    none = F.array().cast("array<struct<s:int,m:string>>")

    def step(done: Column, x: Column) -> Column:
        at = done["pos"] + F.length(x["p"])
        return F.struct(
            (at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
            F.when(x["m"].isNull(), done["out"])
            .otherwise(F.concat(done["out"], F.array(F.struct(at.alias("s"), x["m"].alias("m")))))
            .alias("out"),
        )

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda done: done["out"])
    return F.when(text.rlike(guard), walked).otherwise(none)


def _count(m: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(m, outside, ""))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _passes(kind: int, m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    if kind == IP:
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == CARD:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == PHONE:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def exact_spans(text: Column) -> Column:
    """Start, kind and end of all exact matches, by start and then kind."""

    def of(kind: int) -> Column:
        right = F.filter(_placed(text, _EXACT[kind], _GUARDS[kind]), lambda x: _passes(kind, x["m"]))
        return F.transform(
            right,
            lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), (x["s"] + F.length(x["m"])).alias("e")),
        )

    return F.array_sort(F.concat(*map(of, _EXACT)))


def _candidates(text: Column, exact: Column) -> Column:
    """Further spans with what the trees may know of them; ``y`` is the weak label."""

    def described(kind: int, x: Column) -> Column:
        m, s = x["m"], x["s"]
        e = s + F.length(m)
        digits = _count(m, r"[^0-9]")
        k = F.when(digits >= 13, F.lit(CARD)).otherwise(F.lit(kind)) if kind == PHONE else F.lit(kind)
        before = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
        after = F.substring(text, e + 1, F.lit(1))
        told = F.exists(exact, lambda b: (b["s"] == s) & (b["e"] == e) & (b["k"] == k))
        label = before.rlike(_ASSIGNED) if kind == SECRET else told
        letters = _count(m, r"[^A-Za-z]")
        values = [
            *(k == i for i in range(len(KINDS))), F.length(m), digits, letters, _count(m, r"[^A-Z]"),
            F.length(m) - digits - letters, _count(m, r"[^.]"), m.rlike(r"^[0-9a-fA-F]+$"), m.startswith("+"),
            before.rlike(r"[A-Za-z0-9]$"), after.rlike(r"[A-Za-z0-9]"), before.rlike("[\"']$"), before.rlike(_CUE),
        ]
        return F.struct(
            s.alias("s"), k.alias("k"), e.alias("e"), label.alias("y"),
            F.array(*[v.cast("double") for v in values]).alias("f"),
        )

    def of(kind: int) -> Column:
        return F.transform(_placed(text, _LOOSE[kind], _LOOSE_GUARDS[kind]), lambda x: described(kind, x))

    return F.concat(*map(of, _LOOSE)).cast(_CANDIDATE)


def _tree(node) -> Column:
    """A fitted tree as a column over the candidate ``x``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return lambda f: F.lit(float(node.prediction()))
    left, right = _tree(node.leftChild()), _tree(node.rightChild())
    index, cut = int(node.split().featureIndex()), float(node.split().threshold())
    return lambda f: F.when(f[index] <= cut, left(f)).otherwise(right(f))


class Trees:
    """Boosted trees and a threshold per kind; without a fit they accept nothing."""

    def __init__(self, parts=(), thresholds=None):
        self.parts, self.thresholds = parts, thresholds or {}

    def probability(self, f: Column) -> Column:
        """What the trees give, as a probability; a plain column, so it runs inside array functions."""
        margin = reduce(lambda a, b: a + b, [tree(f) * w for tree, w in self.parts], F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def accepts(self, k: Column, p: Column) -> Column:
        return reduce(lambda a, b: a | b, [(k == i) & (p >= t) for i, t in self.thresholds.items()], F.lit(False))


def fit(found: DataFrame, sample: int = SAMPLE, rounds: int = 12, depth: int = 3) -> Trees:
    """Trees fitted on at most ``sample`` candidates, those of the smallest hash.

    Candidates are labelled by the exact patterns and their checks, secrets by an
    assignment before them; the checks and the assignment are no features.  Four
    fifths of the sample grow the trees.  On all other candidates, in the sample or
    not, each kind gets the lowest of a hundred thresholds at which ``PRECISION`` of
    what it accepts is right.
    """
    rows = found.select("doc_id", F.explode("candidates").alias("c")).select(
        F.shiftrightunsigned(F.xxhash64("doc_id", "c.s", "c.e", "c.k"), 1).alias("h"), F.col("c.k").alias("k"), F.col("c.f").alias("f"),
        F.col("c.y").cast("double").alias("label"),
    )
    drawn = smallest(rows, "h", sample).orderBy("h", "k", "f").limit(sample).checkpoint()
    grow, last = drawn.where("pmod(h, 5) > 0"), drawn.agg(F.max("h")).first()[0]
    ask = rows.where((F.pmod("h", F.lit(5)) == 0) | (F.col("h") > F.lit(last)))
    if last is None:
        return Trees()
    parts = []
    # A sample of one label grows no trees, but kinds that are right elsewhere keep a threshold.
    if grow.agg(F.countDistinct("label")).first()[0] == 2:
        flat = grow.select("label", *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat)
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=3).fit(vectors.select("label", "features"))
        parts = [
            (_tree(t._java_obj.rootNode()), float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)
        ]
    trees = Trees(parts)
    steps = (
        ask.select("k", "label", F.floor(trees.probability(F.col("f")) * 100).alias("step"))
        .groupBy("k", "step")
        .agg(F.count("*").alias("n"), F.sum("label").alias("right"))
        .collect()
    )
    thresholds = {}
    for kind in range(len(KINDS)):
        n = right = 0
        for r in sorted((r for r in steps if r.k == kind), key=lambda r: -r.step):
            n, right = n + r.n, right + r.right
            if right >= PRECISION * n:
                thresholds[kind] = r.step / 100
    return Trees(parts, thresholds)


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the ``exact`` spans and ``spans``, all of them, of every row.

    A span has ``s``, ``k``, ``e``: start, kind (place in ``KINDS``) and end in code
    points.  Candidates whose probability reaches their kind's threshold join the
    exact spans unless they overlap one; of overlapping ones the likeliest stays.  A
    null text is empty; repeated rows and null ids stay; other columns are ignored.
    Candidates are stored once; no text leaves its row and nothing is regrouped.
    """
    use_checkpoints(docs.sparkSession)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    exact = whole.select("doc_id", "text", exact_spans(F.col("text")).alias("exact"))
    found = exact.select("doc_id", "exact", _candidates(F.col("text"), F.col("exact")).alias("candidates")).checkpoint()
    trees = fit(found, sample)

    def overlap(a: Column, b: Column) -> Column:
        return (a["s"] < b["e"]) & (b["s"] < a["e"])

    likely = F.filter(
        F.transform(
            F.col("candidates"),
            lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), trees.probability(x["f"]).alias("p")),
        ),
        lambda x: trees.accepts(x["k"], x["p"]) & ~F.exists("exact", lambda b: overlap(x, b)),
    )
    best = F.filter(
        "likely",
        lambda x: ~F.exists(
            "likely",
            lambda y: overlap(x, y)
            & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (F.struct(y["s"], y["k"], y["e"]) < F.struct(x["s"], x["k"], x["e"])))),
        ),
    )
    added = F.transform(best, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return (
        found.withColumn("likely", likely)
        .withColumn("spans", F.array_sort(F.array_distinct(F.concat("exact", added))))
        .select("doc_id", "exact", "spans")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")
