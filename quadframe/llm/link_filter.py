"""URL filter: host rules, and trust and distrust carried over the link graph; DataFrame functions only."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, written

#: Steps of the propagation, share that moves on, and least distrust beyond the trust that blocks a host.
STEPS, DAMPING, THRESHOLD = 10, 0.85, 0.0
#: Steps between two cuts of the lineage.
CUT = 5
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A link's target, quoted or not, and the host of an absolute or protocol-relative one.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)"
#: Edges of one host that are one key; a host with more is dealt to several.
HUB_EDGES = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int = 0) -> Column:
    """The longest fitting rule (``value`` 0) or its verdict (1); of rules of one length the first."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[value])).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of different hosts, from the absolute links of ``html`` of pages with a host."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    # user name and port are no part of a link's host name
    dst = F.regexp_replace(F.regexp_replace(_lower(F.regexp_extract("link", ABSOLUTE, 1)), "^.*@", ""), ":[0-9]*$", "")
    return links.select("src", dst.alias("dst")).where((F.col("dst") != "") & (F.col("dst") != F.col("src"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score, received: personalised PageRank of each kind from its seeds (kind, host, weight).

    ``edges`` has kind, src, dst.  A step sends ``damping`` of each score along the out-edges in
    equal parts and starts the rest anew at the seeds, by weight; what a host without out-edges would send ends there.
    ``received`` is what came over edges in the last step.  Both kinds run in the same joins, on hosts only, summed before each shuffle.
    The edges of a host with more than HUB_EDGES are dealt to several keys, to each of which its score is copied.
    """
    degree = written(edges.groupBy("kind", "src").agg(F.count("*").alias("n"), F.count("*").alias("out")), "degrees")
    salts = F.ceil(F.col("out") / HUB_EDGES).cast("int")
    weighted = join_hot(edges, degree, ["kind", "src"], "n").select("kind", "src", "dst", (F.lit(damping) / F.col("out")).alias("weight"), F.when(salts > 1, F.pmod(F.xxhash64("dst"), salts)).cast("int").alias("salt"))
    weighted = written(weighted, "edges")
    hubs = written(degree.where(salts > 1).select("kind", "src", salts.alias("salts")), "hubs")
    plain, of_hubs, any_hubs = weighted.where(F.col("salt").isNull()).drop("salt"), weighted.where(F.col("salt").isNotNull()), not hubs.isEmpty()
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("n"))
    start = written(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("n")).alias("score")), "seeds")
    again = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"), F.lit(0.0).alias("received"))
    score = start
    for i in range(1, steps + 1):
        moved = F.col("score") * F.col("weight")
        own = score.withColumnRenamed("host", "src")
        sent = own.join(plain, ["kind", "src"])
        if any_hubs:
            copied = own.join(hubs, ["kind", "src"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            sent = sent.unionByName(copied.join(of_hubs, ["kind", "src", "salt"]).drop("salt"))
        sent = sent.select("kind", F.col("dst").alias("host"), moved.alias("score"), moved.alias("received"))
        score = sent.unionByName(again).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("received").alias("received"))
        if i % CUT == 0 and i < steps:
            score = written(score, "scores")
    return score


def judge_urls(pages: DataFrame, *, key: str = "page_id", rules: Sequence[tuple[str, str]] = RULES, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, rule, verdict (allow or block) and by (rule, links, default) of every url.

    The longest rule that fits decides.  For other urls the links do: a host whose urls rules allow sends trust along
    its links, one whose urls rules block sends distrust against the links that lead to it, each by the share of the host's
    urls; a host that receives more distrust than trust by over ``threshold`` is blocked.  What a seed starts with does not
    count for itself, so a rule on one path condemns no other path, and hosts that no edge
    reaches, null urls and ones without ``://`` are allowed by default.

    Only distinct host pairs are shuffled; the edges of a hub are dealt to several tasks, and the many urls of a host
    meet its verdict by ``join_hot``.  Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    judged = pages.select(F.col(key), F.col("url"), F.col("html")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("own", rule_of(F.col("host"), F.col("path"), rules, 1))
    links = written(host_edges(judged), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    shares = written(judged.groupBy("host").agg(F.count("*").alias("urls"), F.count_if(F.col("own") == "allow").alias("trust"), F.count_if(F.col("own") == "block").alias("distrust")), "shares")
    seeds = shares.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("urls")).alias("weight")) for k in ("trust", "distrust")])).alias("x")).select("x.kind", "host", "x.weight").where("weight > 0")
    scores = propagate(both, seeds, steps, damping)
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("received"))), F.lit(0.0))
    hosts = scores.where("received > 0").groupBy("host").agg(pick("trust").alias("trust"), pick("distrust").alias("distrust"))
    verdicts = hosts.join(shares.select("host", "urls"), "host").select("host", "urls", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow").alias("by_links"))
    found = join_hot(judged.select(key, "host", "path", "rule", "own"), written(verdicts, "verdicts"), ["host"], "urls", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("by_links").isNotNull(), "links").otherwise("default")
    return found.select(key, "host", "path", "rule", F.coalesce("own", "by_links", F.lit("allow")).alias("verdict"), by.alias("by"))


def chained_pages(pages: DataFrame) -> DataFrame:
    """``pages`` whose html is one link to the page of the next page_id: links between the hosts of the given rows."""
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.concat(F.lit('<a href="'), F.col("url"), F.lit('">')).alias("html"))
    return pages.select("page_id", "url").join(following, "page_id", "left")


#: ``chained_pages`` in SQL.
CHAINED = """(SELECT p.page_id, p.url, '<a href="' || n.url || '">' AS html FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1)"""


def oracle(rules: Sequence[tuple[str, str]] = RULES, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD, source: str = "pages") -> str:
    """The same in DuckDB SQL, each step a common table expression."""

    def case(value: int) -> str:
        arms = []
        for rule in sorted(rules, key=lambda r: -len(r[0])):
            name, slash, rest = rule[0].partition("/")
            arms.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[value]}'")
        return f"CASE {' '.join(arms)} END"

    lower = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    href, absolute = HREF.replace("'", "''"), ABSOLUTE
    chain = "".join(
        f"""s{i} AS (SELECT kind, host, sum(score) AS score, sum(received) AS received FROM (
  SELECT w.kind, w.dst AS host, s.score * w.weight AS score, s.score * w.weight AS received FROM s{i - 1} s JOIN weighted w ON s.kind = w.kind AND s.host = w.src
  UNION ALL SELECT kind, host, score * {1 - damping}, 0 FROM s0) GROUP BY kind, host),
"""
        for i in range(1, steps + 1)
    )
    return rf"""
WITH urls AS (SELECT page_id, html, coalesce({lower % "regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {source} pages),
judged AS (SELECT *, {case(0)} AS rule, {case(1)} AS own FROM urls),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM judged WHERE host <> ''),
links AS (SELECT DISTINCT src, dst FROM (SELECT src, regexp_replace(regexp_replace({lower % f"regexp_extract(link, '{absolute}', 1)"}, '^.*@', ''), ':[0-9]*$', '') AS dst FROM found) WHERE dst <> '' AND dst <> src),
both_ways AS (SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links),
weighted AS (SELECT kind, src, dst, {damping} / count(*) OVER (PARTITION BY kind, src) AS weight FROM both_ways),
shares AS (SELECT host, count(*) AS urls, count(*) FILTER (own = 'allow') AS trust, count(*) FILTER (own = 'block') AS distrust FROM judged GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, trust / urls AS weight FROM shares WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust / urls FROM shares WHERE distrust > 0),
s0 AS (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS score FROM seeds),
{chain}hosts AS (SELECT host, CASE WHEN coalesce(sum(received) FILTER (kind = 'distrust'), 0) - coalesce(sum(received) FILTER (kind = 'trust'), 0) > {threshold} THEN 'block' ELSE 'allow' END AS by_links FROM s{steps} WHERE received > 0 GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(own, by_links, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN by_links IS NOT NULL THEN 'links' ELSE 'default' END AS by
FROM judged j LEFT JOIN hosts h ON j.host = h.host"""
