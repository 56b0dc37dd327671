"""WARC revisits: not-modified records resolved by an as-of join to the latest earlier full response.

Captures are joined on a canonical URL. A window over (URL, stretch of time) carries the last full response inside a stretch; what comes
before a stretch is carried over the few rows that sum up each stretch, so that no URL, however frequent, lies in one
task. Bodies and headers stay out of both: only record ids and validators are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What a 304 response may replace (RFC 9110, 15.4.5), and query parameters that only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
#: Rows of one URL in one stretch of time, about.
STRETCH = 10_000

CAPTURE = "record_id long, url string, at long, status int, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme, www./m., user, default port, fragment, tracking parameters, index and .html endings and end slashes go; the host is lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^(?:(?:www|m)\.)+", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.html?$", ""), r"/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{'|'.join(TRACKING)})=")))
    query = F.array_join(pairs, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every capture with its canonical URL and what its record resolves to.

    `captures`: record_id, url, at (time), status, etag, last_modified, digest, headers (lower-case names). Status 304 is a
    not-modified revisit, 200 a full response; others pass through. A revisit resolves to the latest full response of its canonical URL
    before it (by at, then record_id) if every validator it has (etag, else last_modified, else digest) agrees:
    columns resolved_id, outcome (`full`, `revisit`, `mismatch`, `orphan`, `other`), merged_headers (the full
    response's headers, with the permitted ones of the revisit over them). A null URL is no key: such revisits are orphans. Null
    times come before all others; repeated rows are records of their own. Other columns stay; those named like a new one are replaced.
    An empty table gives no rows.

    Rows of one URL are worked on in stretches of time, of about STRETCH rows of the whole table if times are spread evenly; rows
    without a time are cut by record_id. Rows of one URL at one instant are one stretch.
    """
    source = captures.columns
    rows = captures.select(F.struct(*[F.col(c) for c in source]).alias("capture"), "record_id", "url", "at", "status", "etag", "last_modified", "digest", "headers")
    rows = rows.withColumn("canonical", canonical_url(F.col("url"))).withColumn("is_full", F.coalesce(F.col("status") == 200, F.lit(False)))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "warc-captures")
    keys = rows.select("row", "record_id", "canonical", "at", "status", "etag", "last_modified", "digest", "is_full").where("canonical IS NOT NULL")
    some = keys.agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in ("at", "record_id") for f in (F.min, F.max)]).first()
    parts = max(1, -(-some["n"] // STRETCH))

    def part(c: str) -> Column:
        low, high = (some[f"{f}_{c}"] or 0.0 for f in ("min", "max"))
        return F.floor((F.col(c) - F.lit(low)) / F.lit(max(1.0, (high - low + 1) / parts)))

    timeless = F.coalesce(part("record_id"), F.lit(-1)) - F.lit(parts + 1)
    keys = keys.withColumn("stretch", F.coalesce(part("at"), timeless))
    order = [F.col("at").asc_nulls_first(), F.col("record_id"), F.col("row")]
    full = F.struct("at", "record_id", F.col("row").alias("full_row"), F.col("etag").alias("full_etag"), F.col("last_modified").alias("full_modified"), F.col("digest").alias("full_digest"))
    inside = Window.partitionBy("canonical", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("near", F.last(F.when(F.col("is_full"), full), ignorenulls=True).over(inside))
    sums = keys.groupBy("canonical", "stretch").agg(F.max(F.when(F.col("is_full"), full)).alias("latest"))
    earlier = Window.partitionBy("canonical").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("canonical", "stretch", F.last("latest", ignorenulls=True).over(earlier).alias("far"))
    keys = keys.where("status = 304").join(carried, ["canonical", "stretch"]).withColumn("base", F.coalesce("near", "far"))
    agrees = (
        F.when(F.col("etag").isNotNull() & F.col("base.full_etag").isNotNull(), _weak(F.col("etag")) == _weak(F.col("base.full_etag")))
        .when(F.col("last_modified").isNotNull() & F.col("base.full_modified").isNotNull(), F.col("last_modified") == F.col("base.full_modified"))
        .when(F.col("digest").isNotNull() & F.col("base.full_digest").isNotNull(), F.col("digest") == F.col("base.full_digest"))
        .otherwise(False)
    )
    found = keys.select("row", F.when(F.col("base").isNull(), "orphan").when(agrees, "revisit").otherwise("mismatch").alias("found"), F.when(agrees, F.col("base.record_id")).alias("resolved"), F.when(agrees, F.col("base.full_row")).alias("full_row"))
    out = rows.join(found, "row", "left")
    bodies = rows.where("is_full").select(F.col("row").alias("full_row"), F.col("headers").alias("full_headers"))
    out = out.join(bodies, "full_row", "left")
    mine = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("full_headers"), lambda k, v: ~F.map_contains_key(mine, k))
    outcome = F.when(F.col("is_full"), "full").when(F.col("status") == 304, F.coalesce("found", F.lit("orphan"))).otherwise("other")
    return out.select(
        *[F.col("capture")[c].alias(c) for c in source if c not in ("canonical", "outcome", "resolved_id", "merged_headers")], "canonical", outcome.alias("outcome"),
        F.when(F.col("is_full"), F.col("record_id")).otherwise(F.col("resolved")).alias("resolved_id"),
        F.when(F.col("full_row").isNotNull(), F.map_concat(kept, mine)).otherwise(F.col("headers")).alias("merged_headers"),
    )


def _weak(etag: Column) -> Column:
    """Entity tags compare weakly."""
    return F.regexp_replace(etag, "^W/", "")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of a table of pages (page_id, url, html), crawled in page_id order and asked for again later.

    Every page is a full response at time page_id with the md5 of its html as etag and digest. It comes back as a 304 up to 255
    steps later, under a www. address with a tracking parameter; one in sixteen names a stale etag, one in sixteen has a digest only.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    draw = F.md5(F.col("page_id").cast("string").cast("binary"))
    delay = F.conv(F.substring(draw, 1, 2), 16, 10).cast("long") + 1
    kind = F.substring(draw, 3, 1)
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit(200).alias("status"), digest.alias("etag"), F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("etag"), digest, F.lit("date"), F.col("page_id").cast("string"), F.lit("content-type"), F.lit("text/html")).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", r"^https?://(?:www\.)?([^#]*).*$", r"http://www.$1").alias("url"), (F.col("page_id") + delay).alias("at"), F.lit(304).alias("status"),
        F.when(kind == "0", "stale").when(kind != "1", digest).alias("etag"), F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("date"), (F.col("page_id") + delay).cast("string"), F.lit("content-type"), F.lit("text/plain"), F.lit("vary"), F.lit("accept")).alias("headers"),
    )
    return first.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """Digest columns of the resolved captures of a table of pages."""
    h = F.col("merged_headers")
    return resolve_revisits(page_captures(pages)).select("record_id", "canonical", "outcome", "resolved_id", h["etag"].alias("merged_etag"), h["date"].alias("merged_date"), h["content-type"].alias("merged_type"), h["vary"].alias("merged_vary"))


def _canonical_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@]*@)?', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^(?:(?:www|m)\\.)+', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '(?:/index)?\\.html?$', ''), '/+$', '')"
    pairs = f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:{'|'.join(TRACKING)})=')))"
    return f"{host} || {path} || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END"


def oracle_sql() -> str:
    return f"""
    WITH c AS (
      SELECT page_id * 2 AS record_id, url, page_id AS at, 200 AS status, md5(coalesce(html, '')) AS etag, md5(coalesce(html, '')) AS digest, page_id::VARCHAR AS date FROM pages
      UNION ALL
      SELECT page_id * 2 + 1, regexp_replace(url, '^https?://(?:www\\.)?([^#]*).*$', 'http://www.\\1'), page_id + delay, 304,
        CASE WHEN kind = '0' THEN 'stale' WHEN kind <> '1' THEN md5(coalesce(html, '')) END, md5(coalesce(html, '')), (page_id + delay)::VARCHAR
      FROM (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 2))::BIGINT + 1 AS delay, substr(md5(page_id::VARCHAR), 3, 1) AS kind FROM pages)),
    k AS (SELECT *, {_canonical_sql('url')} AS canonical FROM c),
    f AS (SELECT * FROM k WHERE status = 200),
    j AS (SELECT r.record_id, f.record_id AS full_id, f.etag AS full_etag, f.digest AS full_digest FROM k r JOIN f ON r.canonical = f.canonical AND (f.at < r.at OR f.at = r.at AND f.record_id < r.record_id) WHERE r.status = 304
      QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.at DESC, f.record_id DESC) = 1),
    o AS (SELECT k.*, full_id, full_etag, CASE WHEN k.etag IS NOT NULL THEN k.etag = full_etag ELSE k.digest = full_digest END AS agrees FROM k LEFT JOIN j USING (record_id))
    SELECT record_id, canonical, CASE WHEN status = 200 THEN 'full' WHEN full_id IS NULL THEN 'orphan' WHEN agrees THEN 'revisit' ELSE 'mismatch' END AS outcome,
      CASE WHEN status = 200 THEN record_id WHEN agrees THEN full_id END AS resolved_id,
      CASE WHEN status = 200 THEN etag WHEN agrees THEN full_etag END AS merged_etag, date AS merged_date,
      CASE WHEN status = 200 OR agrees THEN 'text/html' ELSE 'text/plain' END AS merged_type, CASE WHEN status = 304 THEN 'accept' END AS merged_vary
    FROM o
    """
