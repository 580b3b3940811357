"""WARC not-modified revisits: an as-of join to the latest earlier full response.

A record is a row of warc_type (response or revisit), target_uri, warc_date,
http_status, http_headers and payload digest. Each revisit with status 304 is
joined, by canonical URL, to the latest response with status 200 that is
strictly earlier. Its validators are checked: entity tags, compared weakly, if
both records have one, else Last-Modified if both have it. When they agree the
revisit takes the response's payload and headers, updated with the headers that
a 304 may change (RFC 9110, section 15.4.5); others in the 304 are ignored.

The as-of join is a window per (URL, time slice) and a window over one row per
slice, so a URL that holds a third of all records is spread over its slices and
no task holds all its records. Payloads never travel: the result refers to the
response by record id; ``with_payload`` joins payloads to resolved revisits.

Defined cases: status ``resolved``; ``mismatch`` if validators disagree;
``unchecked`` if no validator is on both sides (not merged); ``orphan`` if there
is no earlier response; ``no_url`` and ``no_date`` where these are null. Among
responses of one URL and time the greatest record id wins. Repeated revisits
each give a row. No records give no rows; other columns pass by unread.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Headers that a 304 response may update; query parameters that do not name a resource.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"
SLICE_SECONDS = 30 * 86400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port; no scheme, fragment, tracking parameters or final slash; parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^(?i:[a-z][a-z0-9+.-]*)://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """records (record_id, warc_type, target_uri, warc_date, http_status, http_headers map, payload_digest, n_bytes)
    -> one row for each revisit: record_id, url, warc_date, status, ref_id, ref_date, payload_digest, n_bytes, http_headers.

    Header names are expected in lower case.
    """
    url = canonical_url(F.col("target_uri"))
    full = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    revisit = (F.col("warc_type") == "revisit") & (F.col("http_status") == 304)
    rows = records.where(full | revisit).select(
        "record_id", url.alias("url"), F.col("warc_date").alias("ts"), full.alias("full"), "http_headers", "payload_digest", "n_bytes",
        F.floor(F.unix_timestamp("warc_date") / slice_seconds).alias("slice"),
    )
    lost = F.col("url").isNull() | F.col("ts").isNull()
    ref = F.struct("ts", "record_id", "http_headers", "payload_digest", "n_bytes")
    # Of rows of one time revisits come first, so a response is never used for a revisit of its own time.
    order = Window.partitionBy("url", "slice").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = rows.where(~lost)
    local = good.withColumn("near", F.last(F.when(F.col("full"), ref), ignorenulls=True).over(order)).where(~F.col("full"))
    ends = good.where("full").groupBy("url", "slice").agg(F.max_by(ref, F.struct("ts", "record_id")).alias("end"))
    slices = local.select("url", "slice").distinct().join(ends, ["url", "slice"], "full_outer")
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url", "slice", F.last("end", ignorenulls=True).over(before).alias("far"))
    joined = local.join(carried, ["url", "slice"], "left").withColumn("hit", F.coalesce("near", "far"))
    tags = (F.col("http_headers")["etag"], F.col("hit.http_headers")["etag"])
    dates = (F.col("http_headers")["last-modified"], F.col("hit.http_headers")["last-modified"])
    same = F.when(tags[0].isNotNull() & tags[1].isNotNull(), _weak(tags[0]) == _weak(tags[1])).otherwise(dates[0] == dates[1])
    status = F.when(F.col("hit").isNull(), "orphan").when(same, "resolved").when(same.isNull(), "unchecked").otherwise("mismatch")
    update = F.map_filter(F.coalesce("http_headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    base = F.map_filter("hit.http_headers", lambda k, v: ~F.map_contains_key(update, k))
    done = joined.withColumn("status", status)
    ok = F.col("status") == "resolved"
    out = done.select(
        "record_id", "url", F.col("ts").alias("warc_date"), "status", F.when(ok, F.col("hit.record_id")).alias("ref_id"), F.when(ok, F.col("hit.ts")).alias("ref_date"),
        F.when(ok, F.col("hit.payload_digest")).alias("payload_digest"), F.when(ok, F.col("hit.n_bytes")).alias("n_bytes"), F.when(ok, F.map_concat(base, update)).alias("http_headers"),
    )
    none = rows.where(lost & ~F.col("full")).select("record_id", "url", F.col("ts").alias("warc_date"), F.when(F.col("url").isNull(), "no_url").otherwise("no_date").alias("status"))
    return out.unionByName(none, allowMissingColumns=True)


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of the response that each refers to; others keep a null payload."""
    payloads = records.where("warc_type = 'response'").select(F.col("record_id").alias("ref_id"), "payload")
    return resolved.join(payloads, "ref_id", "left")


RECORDS = (
    "record_id string, warc_type string, target_uri string, warc_date timestamp, http_status int, http_headers map<string,string>,"
    " payload_digest string, n_bytes long, payload binary"
)


def _inflated(data: bytes) -> bytes:
    """The content of a file of gzip members, one after another, or of a plain file; a torn member gives what it has."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields with names in lower case; folded lines belong to the field before them, of a repeated one the last counts."""
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def warc_records(data: bytes):
    """(headers, block) of each record of a WARC file; after a damaged record the next version line is looked for."""
    data, at = _inflated(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _fields(data[data.find(b"\r\n", at) + 2 : end])
        size = head.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            at += 5
            continue
        block = data[end + 4 : end + 4 + int(size)]
        yield head, block
        at = end + 4 + len(block)


def _http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, _, rest = head.partition(b"\r\n")
    parts = first.split()
    return (int(parts[1]) if first.startswith(b"HTTP/") and len(parts) > 1 and parts[1].isdigit() else None), _fields(rest), body


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Response and revisit records of WARC files (plain or gzip), as resolve takes them, with the payload.

    A file is read by one task, as a whole; Spark's binary reader takes files of up to 2 GB, twice what is usual.
    A record without a date or target has null there; a payload without a digest gets one (SHA-256).
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in warc_records(content.as_buffer().to_pybytes()):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    status, headers, body = _http(block)
                    date = head.get("warc-date")
                    try:
                        date = date and datetime.fromisoformat(date.replace("Z", "+00:00"))
                    except ValueError:
                        date = None
                    digest = head.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-target-uri", "").strip("<>") or None, date, status, list(headers.items()), digest if kind == "response" else None, len(body), body if kind == "response" else None))
                    size += len(body)
                    if size > 8 << 20 or len(rows) >= 256:
                        yield _record_batch(rows)
                        rows, size = [], 0
                yield _record_batch(rows)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.strip().split(" ")[0] for f in RECORDS.replace("map<string,string>", "map").split(",")])


def crawl(pages: DataFrame) -> DataFrame:
    """pages as records of a crawl: each page one response and one later revisit, times set by page_id.

    Revisits come 10 days after their page, but every 25th comes before it; every tenth (page_id
    mod 10 = 7) has another entity tag, and those of mod 10 = 9 have only Last-Modified.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    time = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)) * 60)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    http = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"
    common = pages.select(F.coalesce("page_id", F.lit(0)).alias("id"), "url", digest.alias("payload_digest"), tag.alias("tag"), time.alias("time"), size.alias("n_bytes"))
    stamp = F.date_format("time", http)
    response = common.select(
        (F.col("id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.col("time").alias("warc_date"), F.lit(200).alias("http_status"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.col("n_bytes").cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("etag"), "tag", F.lit("last-modified"), stamp).alias("http_headers"),
        "payload_digest", "n_bytes",
    )
    late = F.when(F.col("id") % 25 == 0, F.expr("time - interval 1 hour")).otherwise(F.expr("time + interval 10 days"))
    kind = F.col("id") % 10
    revisit_tag = F.when(kind == 7, F.lit('"other"')).when(kind == 9, F.lit(None)).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    headers = F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("etag"), revisit_tag, F.lit("last-modified"), stamp)
    revisit = common.select(
        (F.col("id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), late.alias("warc_date"), F.lit(304).alias("http_status"),
        F.map_filter(headers, lambda k, v: v.isNotNull()).alias("http_headers"), F.lit(None).cast("string").alias("payload_digest"), F.lit(0).cast("long").alias("n_bytes"),
    )
    return response.unionByName(revisit)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")


def op2_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of pages as a crawl of responses and revisits; one row for each revisit."""
    out = resolve(crawl(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select(F.expr("record_id div 2").alias("page_id"), "url", "status", F.expr("ref_id div 2").alias("ref_page_id"), "payload_digest", "n_bytes", header_lines(F.col("http_headers")).alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS id, url AS raw, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n_bytes,
         CAST(1704067200 + page_id * 60 AS BIGINT) AS t,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:[a-z][a-z0-9+.-]*)://', '') AS rest
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))), '&') AS kept,
         strftime(make_timestamp(t * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS stamp
  FROM p),
u AS (SELECT *, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url, '"' || substr(digest, 1, 16) || '"' AS tag FROM c),
v AS (
  SELECT id, url, stamp, CASE WHEN id % 25 = 0 THEN t - 3600 ELSE t + 864000 END AS t,
         CASE WHEN id % 10 = 7 THEN '"other"' WHEN id % 10 = 9 THEN NULL ELSE tag END AS tag
  FROM u),
m AS (
  SELECT v.id, max(struct_pack(t := u.t, id := u.id)) AS hit
  FROM v JOIN u ON u.url = v.url AND u.t < v.t GROUP BY v.id),
j AS (
  SELECT v.id, v.url, v.stamp, v.tag, u.id AS ref, u.digest, u.n_bytes, u.tag AS reftag, u.stamp AS refstamp,
         CASE WHEN u.id IS NULL THEN 'orphan'
              WHEN CASE WHEN v.tag IS NOT NULL THEN v.tag = u.tag ELSE v.stamp = u.stamp END THEN 'resolved'
              ELSE 'mismatch' END AS status
  FROM v LEFT JOIN m ON m.id = v.id LEFT JOIN u ON u.id = m.hit.id)
SELECT id AS page_id, url, status,
       CASE WHEN status = 'resolved' THEN ref END AS ref_page_id,
       CASE WHEN status = 'resolved' THEN digest END AS payload_digest,
       CASE WHEN status = 'resolved' THEN n_bytes END AS n_bytes,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || n_bytes || chr(10) || 'content-type: text/html'
         || chr(10) || 'etag: ' || CASE WHEN tag IS NULL THEN reftag ELSE 'W/' || tag END || chr(10) || 'last-modified: ' || stamp END AS headers
FROM j
"""
