"""WARC: revisit records of "304 Not Modified" answers, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, range_cuts, range_of

#: Headers that a 304 answer may renew in the stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that do not name another document.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` gone, host in lower case without default port, fragment and tracking
    parameters gone, other parameters sorted, an empty path a slash.  Null stays null."""
    trimmed = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(trimmed, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1)), r"^www\.", ""), r":(80|443)?$", "")
    rest = F.regexp_replace(trimmed, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    path = F.regexp_extract(rest, r"(?s)^[^?]*", 0)
    pairs = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve each revisit to the latest earlier full response of its canonical URL.

    ``records`` has record_id, url, ts, kind (``response`` or ``revisit``), status, etag,
    last_modified, digest and headers (map of lower-case names).  Full responses are those of kind response
    with status 200; one at the same time is not earlier; of several at one time the largest
    record_id counts, then the largest etag, last_modified, digest and headers.  A repeated response is one; a repeated
    revisit is a row of its own.  The validators are compared in turn: the revisit's etag (weakly), else its last_modified,
    else its digest; without any it is ``unchecked``.  outcome is resolved, unchecked, mismatch, or unresolved (no
    earlier response, null url or time).

    Returns record_id, canonical, outcome, response_id, digest and merged headers: the response's, with
    those that a 304 may renew taken from the revisit; null where not resolved or unchecked.

    The as-of join runs in ranges of time: a URL's rows in one range meet in one window, and
    its latest response per range, one row each, is carried on, so a hot URL is dealt over all ranges.
    """
    kept = records.select("record_id", "url", "ts", "kind", "status", "etag", "last_modified", "digest", "headers").withColumn("canonical", canonical_url(F.col("url")))
    cuts = range_cuts(kept, "ts", partitions(records.sparkSession))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    rows = kept.where(F.col("kind").isNotNull()).withColumn("span", range_of(F.col("ts"), cuts)).withColumn("is_full", F.coalesce(full, F.lit(False)))
    response = F.when(F.col("is_full"), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # every field takes part, so that of responses alike in time and record_id the same one is the latest however rows are dealt
    order = F.when(F.col("is_full"), F.struct("ts", "record_id", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("entries")))
    rows = rows.where(F.col("is_full") | (F.col("kind") == "revisit")).withColumns({"response": response, "order": order})
    # a null URL has no response to meet, and must not meet in one task
    apart = F.coalesce(F.col("canonical"), F.concat(F.lit("\0"), F.col("record_id").cast("string")))
    rows = rows.withColumn("apart", apart)
    inside = Window.partitionBy("apart", "span").orderBy("ts", "is_full", "order").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where(F.col("kind") == "revisit")
    # one row per URL and range, however often a response is repeated
    ends = rows.groupBy("apart", "span").agg(F.max_by("response", "order").alias("response"))
    carried = ends.withColumn("far", F.last("response", ignorenulls=True).over(Window.partitionBy("apart").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select("apart", "span", "far")
    found = near.join(carried, ["apart", "span"], "left").withColumn("r", F.coalesce("near", "far")).withColumn("r", F.when(F.col("ts").isNotNull(), F.col("r")))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(_strong(F.col("etag")) == _strong(F.col("r.etag")), F.lit(False)))
    same = F.coalesce(same, F.when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("r.last_modified"), F.lit(False))))
    same = F.coalesce(same, F.when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(False))))
    outcome = F.when(F.col("r").isNull(), "unresolved").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*RENEWED))
    stored = F.map_filter(F.coalesce("r.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    taken = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical", "outcome", F.when(taken, F.col("r.record_id")).alias("response_id"), F.when(taken, F.col("r.digest")).alias("digest"), F.when(taken, F.map_concat(stored, renewed)).alias("headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``: every page as a full response and then as a revisit of its URL.

    Page n is fetched at time 2 n, and again at 2 n + 1 with a 304 answer: for n mod 4 of 0 and 1 with
    the right etag (weak for 1), for 2 with the last-modified date alone, for 3 with the etag of other content.
    """
    n = F.col("page_id")
    day = F.concat(F.lit("day "), (n % 28).cast("string"))
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length("html").cast("string").alias("length"), day.alias("day"))
    headers = lambda *pairs: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs])), lambda k, v: v.isNotNull())
    first = base.select((2 * n).alias("record_id"), "url", (2 * n).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.col("digest").alias("etag"), F.col("day").alias("last_modified"), "digest", headers(("content-length", F.col("length")), ("date", 2 * n), ("etag", F.col("digest")), ("last-modified", F.col("day"))).alias("headers"))
    tag = F.when(n % 4 == 0, F.col("digest")).when(n % 4 == 1, F.concat(F.lit("W/"), F.col("digest"))).when(n % 4 == 3, F.md5(F.col("digest")))
    then = base.select((2 * n + 1).alias("record_id"), "url", (2 * n + 1).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), tag.alias("etag"), F.when(n % 4 == 2, F.col("day")).alias("last_modified"), F.lit(None).cast("string").alias("digest"), headers(("content-length", F.lit("0")), ("date", 2 * n + 1), ("etag", tag)).alias("headers"))
    return first.unionByName(then)


def oracle() -> str:
    """``resolve_revisits(captures(pages))`` in DuckDB SQL, as the query returns it."""
    tracking = ", ".join(f"'{x}'" for x in TRACKING)
    return rf"""
WITH parts AS (SELECT page_id, html, regexp_replace(trim(url, ' '), '(?s)#.*$', '') AS u FROM pages),
split AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), '^www\.', ''), ':(80|443)?$', '') AS host,
  regexp_replace(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', '') AS rest FROM parts),
pieces AS (SELECT page_id, html, host, regexp_extract(rest, '(?s)^[^?]*', 0) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND regexp_extract(p, '^[^=]*', 0) NOT IN ({tracking}))), '&') AS query FROM split),
base AS (SELECT page_id, host || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END AS canonical,
  md5(coalesce(html, '')) AS digest, CAST(length(html) AS VARCHAR) AS len, 'day ' || (page_id % 28) AS day FROM pieces),
again AS (SELECT *, 2 * page_id + 1 AS ts, CASE page_id % 4 WHEN 0 THEN digest WHEN 1 THEN 'W/' || digest WHEN 3 THEN md5(digest) END AS etag FROM base),
met AS (SELECT a.*, b.page_id AS r, b.digest AS r_digest, b.day AS r_day, b.len AS r_len FROM again a ASOF LEFT JOIN (SELECT *, 2 * page_id AS rts FROM base) b ON a.canonical = b.canonical AND a.ts > b.rts),
judged AS (SELECT *, CASE WHEN r IS NULL THEN 'unresolved' WHEN page_id % 4 = 2 THEN CASE WHEN day = r_day THEN 'resolved' ELSE 'mismatch' END WHEN regexp_replace(etag, '^W/', '') = r_digest THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met)
SELECT ts AS record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN 2 * r END AS response_id, CASE WHEN outcome = 'resolved' THEN r_digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN coalesce('content-length: ' || r_len || chr(10), '') || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, r_digest) || chr(10) || 'last-modified: ' || r_day END AS headers
FROM judged"""


#: Hexadecimal digits; those of a page's hash decide its record.
DIGITS = "0123456789abcdef"


def site_records(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages`` in which each page is one record, a response or a revisit, of its site: host and first path part.

    Pages of a site share a canonical URL, written in four ways; pages 2 t and 2 t + 1 come at time t.  Digits of the MD5 of
    page_id decide: a response below 8; the way of writing; the revisit's validator (etag below 6, last-modified below a,
    digest below e, else none); how long ago, in steps of 10, the revisit saw what it asks about; and whether the validator is
    of another site (below 3).  A site's etag changes with every 100 of time, its date with every 50, its digest with
    every 200, so only the response found by the as-of search says whether a validator holds.
    """
    n, ts = F.col("page_id"), F.col("ts")
    digit = lambda i: F.instr(F.lit(DIGITS), F.substring(F.md5(n.cast("string")), i, 1)) - 1
    site = F.regexp_extract("url", r"//(?:www\.)?([^/?#]*(?:/[^/?#]*)?)", 1)
    base = pages.select("page_id", site.alias("site"), F.length("html").cast("string").alias("length"), F.floor(n / 2).alias("ts"), *[digit(i).alias(f"h{i}") for i in range(1, 6)])
    written = F.when(F.col("h2") < 4, F.concat(F.lit("http://"), "site")).when(F.col("h2") < 8, F.concat(F.lit("https://www."), "site", F.lit("?ref=x")))
    written = written.when(F.col("h2") < 12, F.concat(F.lit("http://"), "site", F.lit("#top"))).otherwise(F.concat(F.lit("HTTPS://"), "site", F.lit("?utm_source=a&")))
    response = F.col("h1") < 8
    seen = F.when(response, ts).otherwise(F.greatest(F.lit(0), ts - 10 * F.col("h4")))
    of = F.when(~response & (F.col("h5") < 3), F.concat(F.lit("not "), "site")).otherwise(F.col("site"))
    version = lambda period: F.md5(F.concat(of, F.lit(f" {period} "), F.floor(seen / period).cast("string")))
    etag = F.when(response | (F.col("h3") < 6), F.concat(F.when(F.col("h4") < 4, "W/").otherwise(""), version(100)))
    modified = F.when(response | F.col("h3").between(6, 9), version(50))
    digest = F.when(response | F.col("h3").between(10, 13), version(200))
    rows = base.select("page_id", "ts", "length", written.alias("url"), response.alias("response"), etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"))
    pairs = {"content-length": F.when(F.col("response"), F.col("length")).otherwise("0"), "date": ts.cast("string"), "etag": F.col("etag"), "last-modified": F.when(F.col("response"), F.col("last_modified"))}
    headers = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values())), lambda k, v: v.isNotNull())
    return rows.select(n.alias("record_id"), "url", "ts", F.when(F.col("response"), "response").otherwise("revisit").alias("kind"), F.when(F.col("response"), 200).otherwise(304).alias("status"), "etag", "last_modified", "digest", headers.alias("headers"))


def site_oracle() -> str:
    """``resolve_revisits(site_records(pages))`` in DuckDB SQL, as the query returns it."""
    tracking = ", ".join(f"'{x}'" for x in TRACKING)
    digits = ", ".join(f"instr('{DIGITS}', substr(md5(CAST(page_id AS VARCHAR)), {i}, 1)) - 1 AS h{i}" for i in range(1, 6))
    version = lambda period: f"md5(owner || ' {period} ' || CAST(CAST(floor(seen / {period}) AS BIGINT) AS VARCHAR))"
    return rf"""
WITH base AS (SELECT page_id, CAST(length(html) AS VARCHAR) AS len, CAST(floor(page_id / 2) AS BIGINT) AS ts, regexp_extract(url, '//(?:www\.)?([^/?#]*(?:/[^/?#]*)?)', 1) AS site, {digits} FROM pages),
said AS (SELECT *, h1 < 8 AS full_response, CASE WHEN h2 < 4 THEN 'http://' || site WHEN h2 < 8 THEN 'https://www.' || site || '?ref=x' WHEN h2 < 12 THEN 'http://' || site || '#top' ELSE 'HTTPS://' || site || '?utm_source=a&' END AS url,
  CASE WHEN h1 < 8 THEN ts ELSE greatest(0, ts - 10 * h4) END AS seen, CASE WHEN h1 >= 8 AND h5 < 3 THEN 'not ' || site ELSE site END AS owner FROM base),
parts AS (SELECT *, regexp_replace(trim(url, ' '), '(?s)#.*$', '') AS u FROM said),
split AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), '^www\.', ''), ':(80|443)?$', '') AS host,
  regexp_replace(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', '') AS rest FROM parts),
pieces AS (SELECT *, regexp_extract(rest, '(?s)^[^?]*', 0) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND regexp_extract(p, '^[^=]*', 0) NOT IN ({tracking}))), '&') AS query FROM split),
records AS (SELECT page_id, ts, len, full_response, host || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END AS canonical,
  CASE WHEN full_response OR h3 < 6 THEN CASE WHEN h4 < 4 THEN 'W/' ELSE '' END || {version(100)} END AS etag,
  CASE WHEN full_response OR h3 BETWEEN 6 AND 9 THEN {version(50)} END AS last_modified, CASE WHEN full_response OR h3 BETWEEN 10 AND 13 THEN {version(200)} END AS digest FROM pieces),
responses AS (SELECT * FROM records WHERE full_response AND canonical IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical, ts ORDER BY page_id DESC) = 1),
met AS (SELECT a.*, b.page_id AS r, b.etag AS r_etag, b.last_modified AS r_modified, b.digest AS r_digest, b.len AS r_len
  FROM (SELECT * FROM records WHERE NOT full_response) a ASOF LEFT JOIN responses b ON a.canonical = b.canonical AND a.ts > b.ts),
judged AS (SELECT *, CASE WHEN r IS NULL THEN 'unresolved' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
  WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = r_modified THEN 'resolved' ELSE 'mismatch' END
  WHEN digest IS NOT NULL THEN CASE WHEN digest = r_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS outcome FROM met)
SELECT page_id AS record_id, canonical, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN r END AS response_id, CASE WHEN outcome IN ('resolved', 'unchecked') THEN r_digest END AS digest,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN coalesce('content-length: ' || r_len || chr(10), '') || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, r_etag) || chr(10) || 'last-modified: ' || r_modified END AS headers
FROM judged"""
