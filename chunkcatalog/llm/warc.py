"""Not-modified revisits of a web archive resolved to full responses.

A WARC ``revisit`` record says that a page had not changed since an earlier capture. ``resolve`` joins each revisit, by
canonical URL, to the latest earlier full response (an as-of join), checks the validators and merges the headers that a 304 answer may
update into those of the response.

The as-of join is a running last value in two levels: inside blocks of time of one URL, and over the last response of each
block, so one URL with a third of all records is spread over as many tasks as it has blocks. Records move once by (URL,
block); payloads never move, since the result refers to the response by its id.

Outcomes: ``resolved``; ``mismatch`` (a validator differs); ``unverified`` (revisit and response share no validator);
``orphan`` (no earlier response). Headers are merged only for ``resolved``.

Cases: records of one URL at the same time do not precede each other; of several responses at one time the one with the
largest record_id counts; null URL or time make a revisit an orphan and a response useless; null headers are empty;
repeated revisits stay, each with its own row; kinds other than ``response`` and ``revisit`` are ignored, as are extra
columns; responses other than status 200 are not full and are never referred to; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut

# Header fields that a 304 answer must not change, and those that concern one connection alone (RFC 9110, 9111).
KEPT_FIELDS = ("content-encoding", "content-length", "content-range", "content-type")
HOP_FIELDS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BLOCKS = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without closing slashes, query sorted and without tracking fields; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|gclid|fbclid)="))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _permitted(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*KEPT_FIELDS, *HOP_FIELDS))


def _lowered(headers: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    pairs = F.map_entries(F.coalesce(headers, empty))
    names = F.array_distinct(F.transform(pairs, lambda p: F.lower(p["key"])))  # of fields that differ in case the last counts
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: F.lower(p["key"]) == n), -1)["value"]))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """``(record_id, url_key, target_id, outcome, headers)`` for each revisit of
    ``records(record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map)``.
    """
    x = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status", "etag", "last_modified", "digest", _lowered(F.col("headers")).alias("headers"))
    x = cut(x)  # a few short columns of each record, instead of its payload read several times
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lo, hi = x.where(usable).agg(F.min("ts"), F.max("ts")).first()
    lo, width = lo or 0, (hi or 0) - (lo or 0) + 1
    block = F.floor((F.col("ts") - lo) / F.lit(float(width)) * BLOCKS)
    x = x.withColumn("block", block)
    body = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    full = x.where(usable & (F.col("kind") == "response") & (F.col("status") == 200)).groupBy("url_key", "block", "ts").agg(F.max_by(body, "record_id").alias("body"))
    asked = x.where(usable & (F.col("kind") == "revisit"))
    plain = asked.select("url_key", "block", "ts", F.lit(None).cast(full.schema["body"].dataType).alias("body"), body.alias("own"))
    events = full.select("url_key", "block", "ts", "body", F.lit(None).cast(plain.schema["own"].dataType).alias("own")).union(plain)
    earlier = W.partitionBy("url_key", "block").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    inside = events.withColumn("found", F.last("body", ignorenulls=True).over(earlier)).where("own IS NOT NULL")
    tips = full.groupBy("url_key", "block").agg(F.max_by("body", "ts").alias("body"))
    ends = tips.union(asked.select("url_key", "block").distinct().withColumn("body", F.lit(None).cast(full.schema["body"].dataType)))
    ends = ends.groupBy("url_key", "block").agg(F.first("body", ignorenulls=True).alias("body"))
    carried = ends.select("url_key", "block", F.last("body", ignorenulls=True).over(W.partitionBy("url_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    joined = inside.join(carried, ["url_key", "block"], "left").select("url_key", "own", F.coalesce("found", "carried").alias("target"))
    same_tag = _strong(F.col("own.etag")) == _strong(F.col("target.etag"))
    same_date = F.col("own.last_modified") == F.col("target.last_modified")
    same_body = F.col("own.digest") == F.col("target.digest")
    checked = F.coalesce(same_tag, same_date, same_body)  # the first validator that both have
    outcome = F.when(F.col("target").isNull(), "orphan").when(checked.isNull(), "unverified").when(checked, "resolved").otherwise("mismatch")
    done = joined.withColumn("outcome", outcome)
    update = _permitted(F.col("own.headers"))
    merged = F.map_concat(F.map_filter("target.headers", lambda k, v: ~F.map_contains_key(update, k)), update)
    done = done.select(F.col("own.record_id").alias("record_id"), "url_key", F.col("target.record_id").alias("target_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))
    lost = x.where((F.col("kind") == "revisit") & ~usable)
    return done.union(lost.select("record_id", "url_key", F.lit(None).cast(done.schema["target_id"].dataType), F.lit("orphan"), F.lit(None).cast(done.schema["headers"].dataType)))


def header_text(headers: Column) -> Column:
    """``name: value`` lines, ordered by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive made from ``pages(page_id, url, html)``: of each page a full response and a later revisit.

    Revisits come up to 100,000 minutes after their response, so captures of the same URL may lie between; every fifth
    carries a stale validator, every fifth no entity tag, and every eleventh asks for a URL that was never captured.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    dated = F.when(n % 3 != 0, F.concat(F.lit("day "), F.floor(n / 1000).cast("string")))
    size = F.coalesce(F.length("html"), F.lit(0)).cast("string")
    text = lambda x: x.cast("string")
    response = pages.select(
        (n * 2).alias("record_id"), "url", (n * 60).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("etag"), dated.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), size, F.lit("Content-Type"), F.lit("text/html"), F.lit("Server"), F.concat(F.lit("s"), text(n % 7))).alias("headers"),
    )
    later = n * 60 + (n * 7919 % 100000) * 60 + 30
    revisit = pages.select(
        (n * 2 + 1).alias("record_id"), F.concat("url", F.when(n % 11 == 0, "/never").otherwise("#top")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(n % 5 == 0, '"stale"').when(n % 5 != 1, F.concat(F.lit("W/"), tag)).alias("etag"), dated.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), text(n % 600)), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), text(later), F.lit("Connection"), F.lit("close")).alias("headers"),
    )
    return response.union(revisit)
