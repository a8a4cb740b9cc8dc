"""Not-modified revisits of a web archive: each is joined, by canonical URL
and time, to the latest earlier full response; validators are checked and the
permitted headers merged.

Captures have ``record_id`` (long, unique), ``url``, ``ts`` (long), ``status``
(200 full response, 304 not modified), ``headers`` (map of strings, names in
any case) and ``payload``.  The result has one row per revisit with
``outcome``:

* ``resolved``: the response's payload; its headers with those that a 304 may
  update taken from the revisit;
* ``validator_mismatch``: the revisit's ETag (weakly compared) or Last-Modified
  is present and differs from the response's; no payload, own headers;
* ``no_earlier_response``: nothing to refer to.

Scale: the as-of step moves ids and times only, and a hot URL is cut into time
ranges (:func:`xgspark.llm._frame.as_of`).  Payloads are then fetched by id in
a plain shuffle join, which Spark splits when many revisits share a response.

Edge cases: a null URL or time resolves nothing (``no_earlier_response``); null
headers are an empty map; header names that differ in case only are one (the
last wins); a response without a payload is no candidate; of responses that
repeat an id the one with the smallest URL, time, headers and payload counts;
revisits that repeat an id are each resolved by their own URL and time; very
long payloads and URLs are taken whole; an empty table gives an empty table;
extra columns are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import as_of

# FIXED VALUES: headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

# FIXED VALUES: canonical form, as (pattern, replacement) in order.
CANONICAL_RULES = (
    (r"#.*$", ""),
    (r"%2[Dd]", "-"),
    (r"%2[Ee]", "."),
    (r"%5[Ff]", "_"),
    (r"%7[Ee]", "~"),
    (r"^(http://[^/?]*?):80(/|\?|$)", "$1$2"),
    (r"^(https://[^/?]*?):443(/|\?|$)", "$1$2"),
    (r"^[a-z][a-z0-9+.-]*://", ""),
    (r"^www\.", ""),
    (r"([?&])utm_[a-z]+=[^&]*", "$1"),
    (r"([?&])&+", "$1"),
    (r"[?&]+$", ""),
    (r"/+$", ""),
)


def canonical(url: Column) -> Column:
    """Scheme, ``www.``, the scheme's own default port, fragment, ``utm_*``
    parameters and trailing slashes removed; the host in lower case; the marks
    that need no escape (``- . _ ~``) unescaped."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    out = F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)))
    for pattern, replacement in CANONICAL_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of equal names, the last."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"])
    return F.coalesce(F.map_from_arrays(names, last), F.create_map().cast("map<string,string>"))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^\s*[Ww]/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated with the permitted ones of the revisit."""
    allowed = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``record_id, canonical_url, ts, outcome, response_id, headers, payload``
    of every not-modified capture."""
    rows = captures.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "status",
                           _lowered(F.col("headers")).alias("headers"), "payload")
    revisits = rows.filter("status = 304").drop("payload", "status")
    # Of repeated ids the smallest row: maps have no order, their entries do.
    entries = F.array_sort(F.map_entries("headers"))
    responses = rows.filter("status = 200 and payload is not null").groupBy("record_id").agg(
        F.min(F.struct("canonical_url", "ts", entries.alias("entries"), "payload")).alias("r")) \
        .select("record_id", "r.canonical_url", "r.ts", F.map_from_entries("r.entries").alias("headers"), "r.payload")

    def keyed(df):
        return df.filter("canonical_url is not null and ts is not null") \
                 .select("canonical_url", F.col("ts").alias("at"), F.col("record_id").alias("id"))

    probes = keyed(revisits).distinct().withColumns({"probe_url": F.col("canonical_url"), "probe_at": F.col("at")})
    found = as_of(probes, keyed(responses), ["canonical_url"]).withColumnRenamed("id", "probe_id")
    linked = revisits.join(found, (F.col("record_id") == F.col("probe_id")) & (F.col("canonical_url") == F.col("probe_url"))
                           & (F.col("ts") == F.col("probe_at")), "left")
    full = responses.select(F.col("record_id").alias("full_id"), F.col("headers").alias("full_headers"), "payload")
    # Revisits without a response have no key: a hash of their own id spreads them.
    spread = F.coalesce("base_id", F.xxhash64("record_id"))
    out = linked.join(full, (spread == F.col("full_id")) & F.col("base_id").isNotNull(), "left")

    def differs(name: str, form=lambda c: c) -> Column:
        mine, theirs = F.col("headers")[name], F.col("full_headers")[name]
        return mine.isNotNull() & ~F.coalesce(form(mine) == form(theirs), F.lit(False))

    outcome = F.when(F.col("base_id").isNull(), "no_earlier_response") \
               .when(differs("etag", _strong) | differs("last-modified"), "validator_mismatch").otherwise("resolved")
    ok = F.col("outcome") == "resolved"
    return (out.withColumn("outcome", outcome)
               .select("record_id", "canonical_url", "ts", "outcome", F.col("base_id").alias("response_id"),
                       F.when(ok, merged_headers(F.col("full_headers"), F.col("headers")))
                        .otherwise(F.col("headers")).alias("headers"),
                       F.when(ok, F.col("payload")).alias("payload")))


def captures_view(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``: every page is a full response, and is
    revisited some time later.  By page id, some revisits carry another ETag,
    no validator, a weak ETag, or come before any response."""
    p = F.col("page_id")
    etag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    common = [F.lit("Date"), F.concat(F.lit("day "), (p % 365).cast("string"))]
    full = pages.select((p * 2).alias("record_id"), "url", (p * 2).alias("ts"), F.lit(200).alias("status"),
                        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, *common).alias("headers"),
                        F.col("html").alias("payload"))
    sent = F.when(p % 7 == 3, F.lit('"other"')).when(p % 11 == 5, F.lit(None).cast("string")) \
            .when(p % 5 == 1, F.concat(F.lit("W/"), etag)).otherwise(etag)
    at = F.when(p % 13 == 6, F.lit(-1)).otherwise(p * 2 + 1 + p * 7919 % 5000)
    headers = F.map_filter(F.create_map(F.lit("ETAG"), sent, F.lit("Cache-Control"), F.lit("max-age=60"),
                                        F.lit("Content-Type"), F.lit("text/plain"),
                                        F.lit("date"), F.concat(F.lit("later "), (p % 365).cast("string"))),
                           lambda k, v: v.isNotNull())
    revisit = pages.select((p * 2 + 1).alias("record_id"), "url", at.cast("bigint").alias("ts"), F.lit(304).alias("status"),
                           headers.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(revisit)


def op3_revisits(spark, sf_dir) -> DataFrame:
    """One row per revisit of the captures derived from ``pages``."""
    from xgspark.sources.tables import read_table

    got = resolve_revisits(captures_view(read_table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("record_id", "canonical_url", "ts", "outcome", "response_id",
                      F.array_join(pairs, ";").alias("headers"),
                      F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows."""
    url = "concat(lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)), " \
          "substr(url, length(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) + 1))"
    for pattern, replacement in CANONICAL_RULES:
        to = replacement.replace("$", "\\")
        url = f"regexp_replace({url}, '{pattern}', '{to}', 'g')"
    return rf"""
WITH p AS (SELECT page_id, {url} AS canonical_url, html, '"' || md5(html) || '"' AS etag,
                  CAST(page_id % 365 AS VARCHAR) AS day FROM pages),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, canonical_url, day,
         CAST(CASE WHEN page_id % 13 = 6 THEN -1 ELSE page_id * 2 + 1 + page_id * 7919 % 5000 END AS BIGINT) AS ts,
         CASE WHEN page_id % 7 = 3 THEN '"other"' WHEN page_id % 11 = 5 THEN NULL
              WHEN page_id % 5 = 1 THEN 'W/' || etag ELSE etag END AS sent FROM p),
earlier AS (
  SELECT r.record_id, arg_max(f.page_id, f.page_id) AS base FROM revisits r
  JOIN p f ON f.canonical_url = r.canonical_url
    AND (f.page_id * 2 < r.ts OR (f.page_id * 2 = r.ts AND f.page_id * 2 < r.record_id))
  GROUP BY r.record_id),
joined AS (
  SELECT r.*, e.base, f.html, f.etag, CASE WHEN e.base IS NULL THEN 'no_earlier_response'
         WHEN sent IS NOT NULL AND replace(sent, 'W/', '') <> f.etag THEN 'validator_mismatch' ELSE 'resolved' END AS outcome
  FROM revisits r LEFT JOIN earlier e USING (record_id) LEFT JOIN p f ON f.page_id = e.base)
SELECT record_id, canonical_url, ts, outcome, base * 2 AS response_id,
       'cache-control=max-age=60;content-type=' || CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END
         || ';date=later ' || day || CASE WHEN sent IS NOT NULL THEN ';etag=' || sent
              WHEN outcome = 'resolved' THEN ';etag=' || etag ELSE '' END AS headers,
       CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM joined"""
