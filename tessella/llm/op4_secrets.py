"""Secret scan with DataFrame functions only: three fixed kinds and a randomness test battery.

The fixed kinds (assign, access, hex) are leftmost non-overlapping matches with
a length rule. A regular expression function gives matches but not positions,
so positions are running sums over the pieces between matches and the matches.

The battery takes every run of 20 or more token characters, infers its encoding
(hex, base32, base64) and tests the
hypothesis that its symbols are uniform and independent: chi-squared over the
alphabet, Wald-Wolfowitz runs about the alphabet's middle, lag-1 serial
correlation; Fisher's method joins the three. Random tokens have uniform
p-values, structured ones p-values near 0. Per length stratum and encoding the
number of random tokens is estimated from the upper half of the p-values
(Storey), which gives the expected share of structured tokens above any bound;
the smallest bound at which this share is at most ``FDR`` is used. A stratum of
fewer than ``THIN`` tokens takes the counts of its encoding at every length, and
an encoding of fewer those of all, so that a lone token is judged by its like.
Tokens above the bound that no fixed span overlaps are added as kind ``random``.

The bounds come from counts over all documents: a histogram of at most
strata x encodings x bins = 6 x 3 x 50 rows, the only thing the driver sees.

Defined cases: null text is empty and has no spans; texts of any length are
scanned whole; repeated rows give equal rows; no rows give no rows; other
columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# Kinds in their order, pattern, group whose length counts, least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RANDOM_KIND = "random"
FDR, BINS, THIN, RUN = 0.05, 50, 50, 128
STRATA = (24, 32, 40, 64, 128)
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all leftmost non-overlapping matches; value is the given group."""
    p = F.lit(pattern)
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    rows = F.arrays_zip(between.alias("b"), hits.alias("h"), values.alias("v"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.coalesce(F.length(x["h"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    # Runs of RUN matches, each summed from 0, then the runs' own offsets: appending to one long list would copy it at every match.
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN)), lambda i: F.aggregate(F.slice(rows, (i * RUN + 1).cast("int"), F.lit(RUN)), begin, step))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets_of = lambda p: F.aggregate(p, first, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    shift = lambda p, o: F.transform(p["out"], lambda m: F.struct((m["start"] + o).alias("start"), (m["end"] + o).alias("end"), m["value"].alias("value")))
    both = F.transform(F.array(F.struct(parts.alias("p"))), lambda s: F.zip_with(s["p"], offsets_of(s["p"]), shift))
    found = F.filter(F.flatten(both[0]), lambda m: m["value"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed kinds, sorted by start, then kind."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        good = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)  # noqa: B023
        out.append(F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))))  # noqa: B023
    return F.array_sort(F.concat(*out))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 0.0002)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _normal_tail(F.abs(z)))


def battery(token: Column) -> Column:
    """struct<encoding int, p double> of one token; null if it has under 20 characters or no encoding."""
    body = F.regexp_replace(token, "=+$", "")
    encoding = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        encoding = F.when(body.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(encoding)
    size = F.element_at(F.array(*[F.lit(float(len(a))) for *_, a in ENCODINGS]), encoding + 1)
    alphabet = F.element_at(F.array(*[F.lit(a) for *_, a in ENCODINGS]), encoding + 1)
    plain = F.when(encoding == 0, F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    state = F.struct(plain.alias("t"), encoding.alias("e"), size.alias("k"), alphabet.alias("a"))

    def counts(s: Column) -> Column:
        n = F.length(s["t"]).cast("double")
        squares = F.aggregate(F.split(s["a"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s["t"], c, F.lit(""))), 2.0))
        index = F.transform(F.split(s["t"], ""), lambda c: (F.instr(s["a"], c) - 1).cast("double"))
        return F.struct(s["e"].alias("e"), s["k"].alias("k"), n.alias("n"), squares.alias("sq"), index.alias("x"))

    def stats(s: Column) -> Column:
        x, n, k = s["x"], s["n"], s["k"]
        df = k - 1.0
        chi = s["sq"] * k / n - n
        p_chi = _normal_tail((F.pow(chi / df, 1.0 / 3) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df)))
        high = F.transform(x, lambda v: (v >= k / 2.0).cast("int"))
        tail = F.slice(high, 2, F.size(high))
        n1 = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
        n2 = n - n1
        runs = 1.0 + F.aggregate(F.zip_with(high, tail, lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))), F.lit(0), lambda a, v: a + v)
        mean = 2.0 * n1 * n2 / n + 1.0
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        p_runs = F.when(var > 0.0, _two_sided((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(F.lit(1e-9))
        mid = (k - 1.0) / 2.0
        spread = (k * k - 1.0) / 12.0
        products = F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: F.coalesce((a - mid) * (b - mid), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
        p_serial = _two_sided(products / (spread * F.sqrt(n - 1.0)))
        half = -F.log(F.greatest(p_chi, F.lit(1e-9))) - F.log(F.greatest(p_runs, F.lit(1e-9))) - F.log(F.greatest(p_serial, F.lit(1e-9)))
        return F.struct(s["e"].alias("encoding"), F.least(F.lit(1.0), F.exp(-half) * (1.0 + half + half * half / 2.0)).alias("p"))

    # One-element arrays stand for local variables: each is computed once.
    done = F.transform(F.transform(F.array(state), counts), stats)
    return F.when((F.length(body) >= 20) & encoding.isNotNull(), F.element_at(done, 1))


def candidates(text: Column) -> Column:
    """array<struct<start, end, encoding, p>> of the tokens that the battery tested."""
    tested = F.transform(matches(text, CANDIDATE, 0), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["value"]).alias("b")))
    good = F.filter(tested, lambda c: c["b"].isNotNull())
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["b"]["encoding"].alias("encoding"), c["b"]["p"].alias("p")))


def stratum(length: Column) -> Column:
    out = F.lit(0)
    for bound in STRATA:
        out = out + (length >= bound).cast("int")
    return out


def bounds(histogram: list[tuple[int, int, int, int]], fdr: float = FDR, thin: int = THIN) -> dict[tuple[int, int], float]:
    """(stratum, encoding, bin of p, count) -> the least p that counts as random, by stratum and encoding."""
    cells: dict[tuple, list[int]] = {}
    for s, e, b, n in histogram:
        for key in ((s, e), (None, e), (None, None)):
            cells.setdefault(key, [0] * BINS)[b] += n
    out = {}
    for s, e in [k for k in cells if k[0] is not None]:
        count = next((cells[k] for k in ((s, e), (None, e)) if sum(cells[k]) >= thin), cells[None, None])
        random_ = 2.0 * sum(count[BINS // 2 :])
        for b in range(1, BINS):
            above = sum(count[b:])
            if above and max(0.0, above - random_ * (1 - b / BINS)) <= fdr * above:
                out[s, e] = b / BINS
                break
        else:
            out[s, e] = 1.0
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base and found: arrays of struct<start, kind, end>; kind 3 is random."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("cands")), "secret-scan")
    length = F.col("c.end") - F.col("c.start")
    histogram = (
        rows.select(F.explode("cands").alias("c"))
        .groupBy(stratum(length).alias("s"), F.col("c.encoding").alias("e"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("b"))
        .count()
        .collect()
    )
    limits = bounds([tuple(r) for r in histogram], fdr)

    def chosen(c: Column) -> Column:
        limit = F.lit(2.0)
        for (s, e), p in limits.items():
            limit = F.when((stratum(c["end"] - c["start"]) == s) & (c["encoding"] == e), F.lit(p)).otherwise(limit)
        free = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return (c["p"] >= limit) & free

    extra = F.transform(F.filter("cands", chosen), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", extra.cast(_SPAN))).alias("found"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit(RANDOM_KIND))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    found = scan(table(spark, sf_dir, "documents"))
    # A lambda of two parameters would get the place of the span as the second one.
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("found").alias("spans"))
