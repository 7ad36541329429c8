"""URL rules, and trust and distrust spread over host links; built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints

#: Rules of the query: host and path prefix, and what to do.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rules become one expression; more than this raise.
MOST_RULES = 1_000
DAMPING = 0.85
ROUNDS = 10
#: Scores are compared to so many decimals, so the order of sums does not matter.
DECIMALS = 9

_AFTER = r"^[^/?#]*"
#: Links to a named host; a link without one stays on its own host.
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_LOW = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, _AFTER, 0), *_LOW),
            "path": F.regexp_extract(rest, _AFTER + r"([^?#]*)", 1),
        }
    )


def rule_of(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits ``host`` and ``path``, with its verdict; null if none does.

    Of rules of one length the first in order of text wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how many links of each host name another host.

    Counted within each task first, so a host with very many pages is few rows.
    """
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), target.alias("dst"))
    return (
        links.select("src", F.translate("dst", *_LOW).alias("dst"))
        .where("src <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``kind, host, score`` after some rounds of personalised PageRank.

    ``seeds`` has ``kind`` and ``host``, each with a score of 1 to begin with.  Trust
    follows the links; distrust goes against them, to the hosts that link to bad ones.
    A host shares its score among its links by their number; what a host without
    links would pass on is lost.  Both kinds run through the same joins.  A round is
    one join and one sum; a host with very many links is split by the skew join.
    """
    use_checkpoints(links.sparkSession)
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    shares = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = both.join(shares, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share"))
    edges = edges.checkpoint()
    start = seeds.select("kind", "host", F.lit(1.0).alias("score")).distinct()
    base = start.withColumn("score", F.col("score") * (1 - damping))
    scores = start
    for k in range(rounds):
        passed = scores.join(edges, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = passed.union(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 5 == 4:
            scores = scores.checkpoint()
    return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row.

    The longest rule that fits decides.  Other pages go by their host: a host of
    which rules allow over half the pages is a trusted seed, one of which they block
    over half a blocked seed; a page is blocked if its host ends with more distrust
    than trust, else allowed.  Null urls have an empty host, which is no seed.
    Null html has no links; repeated rows count and stay.
    """
    use_checkpoints(pages.sparkSession)
    placed = with_host_and_path(pages.select("page_id", "url", "html"))
    ruled = placed.select("page_id", "host", "path", rule_of(rules).alias("r"))
    rows = ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"))
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("own") == "allow").alias("good"), F.count_if(F.col("own") == "block").alias("bad")
    )
    seeds = (
        hosts.select("host", F.explode(F.array(
            F.when(F.col("good") * 2 > F.col("n"), F.lit("trust")), F.when(F.col("bad") * 2 > F.col("n"), F.lit("distrust"))
        )).alias("kind")).where("kind IS NOT NULL")
    ).checkpoint()
    scores = spread(host_links(placed), seeds, rounds=rounds)
    kinds = [F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), DECIMALS).alias(k) for k in ("trust", "distrust")]
    by_host = scores.groupBy("host").agg(*kinds)
    out = rows.join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), "trust", "distrust")


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, rounds: int = ROUNDS) -> str:
    """The same over ``pages``, as plain SQL."""
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases.append((fits, rule, verdict))
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in cases)
    own = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in cases)
    link = _LINK.replace("'", "''")
    steps = ",\n".join(
        f"""r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT r.kind, e.dest AS host, r.score * e.share * {DAMPING} AS score FROM r{k} r JOIN e ON r.kind = e.kind AND r.host = e.host
  UNION ALL SELECT kind, host, score * {1 - DAMPING} FROM r0) GROUP BY kind, host)"""
        for k in range(rounds)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_LOW[0]}', '{_LOW[1]}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {own} END AS own FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (own = 'allow') AS good, count(*) FILTER (own = 'block') AS bad
      FROM j WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT 'trust' AS kind, host, 1.0::DOUBLE AS score FROM h WHERE 2 * good > n
       UNION ALL SELECT 'distrust', host, 1.0::DOUBLE FROM h WHERE 2 * bad > n),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM p),
g AS (SELECT src, translate(dst, '{_LOW[0]}', '{_LOW[1]}') AS dst, count(*) AS n FROM l WHERE src <> '' GROUP BY ALL),
b AS (SELECT 'trust' AS kind, src AS host, dst AS dest, n FROM g WHERE src <> dst
      UNION ALL SELECT 'distrust', dst, src, n FROM g WHERE src <> dst),
e AS MATERIALIZED (SELECT kind, host, dest, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM b),
{steps},
s AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), {DECIMALS}) AS trust,
             round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), {DECIMALS}) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host"""
