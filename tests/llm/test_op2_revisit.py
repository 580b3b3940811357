import gzip
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.llm import op2_revisit as m

DDL = "record_id long, warc_type string, target_uri string, warc_date timestamp, http_status int, http_headers map<string,string>, payload_digest string, n_bytes long, status string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    out = {}
    for rid, kind, uri, at, code, headers, *_ in rows:
        if kind != "revisit" or code != 304:
            continue
        if uri is None or at is None:
            out[rid] = ("no_url" if uri is None else "no_date", None, None)
            continue
        full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == uri and r[3] is not None and r[3] < at]
        if not full:
            out[rid] = ("orphan", None, None)
            continue
        best = max(full, key=lambda r: (r[3], r[0]))
        a, b = headers or {}, best[5] or {}
        if "etag" in a and "etag" in b:
            same = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/")
        elif "last-modified" in a and "last-modified" in b:
            same = a["last-modified"] == b["last-modified"]
        else:
            same = None
        if not same:
            out[rid] = ("unchecked" if same is None else "mismatch", None, None)
        else:
            out[rid] = ("resolved", best[0], {**b, **{k: v for k, v in a.items() if k in m.PERMITTED}})
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        headers = {k: rng.choice(("1", "2", "W/1")) for k in rng.sample(["etag", "last-modified", "date", "content-type", "x-a"], rng.randrange(5))}
        kind = rng.choice(("response", "revisit", "revisit", "request"))
        uri = rng.choice(["a.example/x"] * 6 + ["b.example", "c.example/y", None])
        at = None if i % 50 == 7 else T0 + timedelta(hours=rng.randrange(60))
        rows.append((i, kind, uri, at, {"response": rng.choice((200, 200, 404)), "revisit": 304}.get(kind, 0), headers or None, f"d{i}", i, "clash"))
    for seconds in (3600 * 5, m.SLICE_SECONDS):
        out = {r.record_id: r for r in m.resolve(spark.createDataFrame(rows, DDL), seconds).collect()}
        want = brute(rows)
        assert set(out) == set(want) and {x[0] for x in want.values()} == {"resolved", "mismatch", "unchecked", "orphan", "no_url", "no_date"}
        for rid, (status, ref, headers) in want.items():
            r = out[rid]
            assert (r.status, r.ref_id, r.http_headers) == (status, ref, headers) and r.payload_digest == (f"d{ref}" if ref is not None else None)


def test_repeated_rows_payloads_and_nothing(spark):
    rows = [(1, "response", "http://A.example/?b=2&a=1&utm_x=3#f", T0, 200, {"etag": "1"}, "d", 3, ""), *[(2, "revisit", "https://www.a.example:443?a=1&b=2", T0 + timedelta(days=90), 304, {"etag": "W/1"}, None, 0, "")] * 2]
    records = spark.createDataFrame(rows, DDL)
    out = m.resolve(records)
    assert [(r.status, r.ref_id, r.url) for r in out.collect()] == [("resolved", 1, "a.example?a=1&b=2")] * 2
    full = m.with_payload(out, records.withColumn("payload", F.lit("text")))
    assert [r.payload for r in full.collect()] == ["text"] * 2
    assert m.resolve(records.limit(0)).count() == 0


def test_canonical_url(spark):
    cases = {"HTTP://www.X.org:80/a/?utm_source=f&ref=x#t": "x.org/a", "https://x.org": "x.org", "x.org/A?b=1&&a=2": "x.org/A?a=2&b=1", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", m.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


def warc(kind, uri, date, block, extra=()):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}:{date}>"), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []), *extra, ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_files_of_records(spark, tmp_path):
    """Revisits of gzip and plain files, with a damaged record and a torn end, resolved against the responses in them."""
    page = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nX-Long: one\r\n two\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0 in a page\r\n\r\n</p>"
    same = b"HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nCache-Control: no-store\r\n\r\n"
    info = warc("warcinfo", None, "2024-01-01T00:00:00Z", b"software: x\r\n")
    first = warc("response", "http://Site.example/p?utm_source=x", "2024-01-02T00:00:00Z", page, [("WARC-Payload-Digest", "sha1:AB")])
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nlost\r\n\r\n"
    later = warc("revisit", "https://www.site.example/p", "2024-02-02T00:00:00Z", same)
    none = warc("revisit", None, "2024-02-03T00:00:00Z", same)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, first))) + gzip.compress(later)[:20])
    (tmp_path / "b.warc").write_bytes(bad + later + none + first[: len(first) // 2])
    (tmp_path / "c.warc").write_bytes(b"")
    records = m.read_warc(spark, str(tmp_path))
    rows = records.collect()
    assert sorted(r.warc_type for r in rows) == ["response", "revisit", "revisit"]
    got = next(r for r in rows if r.warc_type == "response")
    assert bytes(got.payload) == page.split(b"\r\n\r\n", 1)[1] and got.http_headers["x-long"] == "one two" and got.payload_digest == "sha1:AB" and got.n_bytes == len(got.payload)
    out = {r.status: r for r in m.with_payload(m.resolve(records), records).collect()}
    assert set(out) == {"resolved", "no_url"} and out["resolved"].payload_digest == "sha1:AB" and bytes(out["resolved"].payload) == bytes(got.payload)
    assert out["resolved"].http_headers == {"etag": 'W/"a"', "cache-control": "no-store", "x-long": "one two", "content-type": "text/html"}
