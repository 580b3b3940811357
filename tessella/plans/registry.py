"""Queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..operators import curation as C
from ..operators import metrics as M
from ..operators import mining as N
from ..operators import responses as R
from ..operators import runner as X
from ..operators import store as S
from ..operators import verification as V
from .lean_files import DEFINED, FILES, files

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "waterfall_documents"


def query(sql: str | None = None):
    """Register a function (read -> DataFrame), read being a loader of tables, under its name."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# ---- pass@k ------------------------------------------------------------------------------------

_TASKS = """
tasks AS (
  SELECT o_orderpriority AS model, o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
each AS (
  SELECT model, n, unnest(generate_series(1, CAST(greatest(1, floor(n * 0.8)) AS BIGINT))) AS k, c FROM tasks),
p AS (
  SELECT model, n, k, CASE WHEN n = 0 OR c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
    ELSE 1.0 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(generate_series(n - c + 1, n), lambda i: 1.0 - k::DOUBLE / i)), lambda a, b: a * b) END AS p
  FROM each)
"""


def _tasks(read) -> DataFrame:
    rows = read("lineitem").select("l_orderkey", "l_returnflag").join(read("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return M.counts_by_task(rows.withColumnRenamed("o_orderpriority", "model"), ["o_orderkey"], F.col("l_returnflag") == "R", ["model"])


def _rounded(metrics: DataFrame) -> DataFrame:
    """Values to 9 places: sums of floating-point numbers depend on their order."""
    return metrics.withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(f"WITH {_TASKS} SELECT model, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, round(avg(p), 9) AS pass_at_k FROM p GROUP BY ALL")
def passk_by_priority(read):
    """Orders are tasks, their lines are candidates, returned lines are right; priorities are models."""
    return _rounded(M.pass_at_k(_tasks(read), ratio=0.8, config=["model", "n"], n="n"))


@query(f"WITH {_TASKS}, t AS (SELECT count(*) AS total FROM orders) SELECT model, CAST(k AS INTEGER) AS k, round(sum(p) / greatest((SELECT total FROM t), count(*)), 9) AS pass_at_k FROM p GROUP BY model, k")
def passk_zero_padded(read):
    """Mean over all orders, those without a candidate counting as 0."""
    return _rounded(M.pass_at_k(_tasks(read), total=read("orders").count(), ratio=0.8, config=["model"], n="n"))


@query(f"WITH {_TASKS} SELECT model, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, round(avg(p), 9) AS pass_at_k FROM p WHERE k = greatest(1, floor(n * 0.8)) GROUP BY ALL")
def passk_single_k(read):
    return _rounded(M.single_k(_tasks(read), ratio=0.8, config=["model", "n"], n="n"))


@query(f"""WITH {_TASKS}, m AS (SELECT model, 0.5 AS temperature, CAST(n AS INTEGER) AS n_responses, CAST(k AS INTEGER) AS k, avg(p) AS v FROM p GROUP BY ALL),
g AS (SELECT DISTINCT o_orderpriority AS model, 0.5 AS temperature, CAST(unnest([6, 20]) AS INTEGER) AS n_responses FROM orders UNION SELECT 'absent', 0.5, 6),
k AS (SELECT *, CAST(unnest(generate_series(1, CAST(floor(n_responses * 0.7) AS BIGINT))) AS INTEGER) AS k FROM g)
SELECT coalesce(m.model, k.model) AS model, CAST(0.5 AS DOUBLE) AS temperature, coalesce(m.n_responses, k.n_responses) AS n_responses, coalesce(m.k, k.k) AS k, round(coalesce(v, 0.0), 9) AS pass_at_k
FROM m FULL OUTER JOIN k ON m.model = k.model AND m.n_responses = k.n_responses AND m.k = k.k""")
def metrics_grid(read):
    """Configured grid joined with what was found: 0 where nothing was (20 samples, a model without any), unconfigured rows stay."""
    tasks = _tasks(read).select("model", F.lit(0.5).alias("temperature"), F.col("n").cast("int").alias("n_responses"), "c")
    configured = read("orders").select(F.col("o_orderpriority").alias("model"), F.lit(0.5).alias("temperature"), F.explode(F.array(F.lit(6), F.lit(20))).alias("n_responses")).distinct()
    configured = configured.unionByName(read("region").limit(1).select(F.lit("absent").alias("model"), F.lit(0.5).alias("temperature"), F.lit(6).alias("n_responses")))
    return _rounded(M.complete_grid(M.pass_at_k(tasks, ratio=0.8), configured, 0.7))


@query(f"WITH {_TASKS}, m AS (SELECT model, CAST(n AS BIGINT) AS n, k, avg(p) AS v FROM p GROUP BY ALL) SELECT model, CAST(n AS INTEGER) AS n_responses, string_agg(k || '=' || round(v, 6), ' ' ORDER BY k) AS points FROM m GROUP BY model, n")
def metric_series(read):
    """Points of each curve by ascending k."""
    tasks = _tasks(read).select("model", F.lit(0.5).alias("temperature"), F.col("n").cast("int").alias("n_responses"), "c")
    found = M.series(M.pass_at_k(tasks, ratio=0.8))
    return found.select("model", "n_responses", F.array_join(F.transform("points", lambda p: F.concat(p["k"].cast("string"), F.lit("="), F.round(p["value"], 6).cast("string"))), " ").alias("points"))


@query("SELECT DISTINCT r_name AS model FROM region UNION SELECT DISTINCT n_name FROM nation")
def metric_labels(read):
    return M.labels_of(read("region").select(F.col("r_name").alias("model")), read("nation").select(F.col("n_name").alias("model")))


# ---- curation ----------------------------------------------------------------------------------


def _document_stages():
    text = F.col("text")
    return [
        ("language", F.col("lang").isin("en", "fr"), "English or French"),
        ("longer", F.col("n_chars") > 200, "more than 200 characters"),
        ("size", C.within_changes(F.col("n_chars"), 1, 10000), "at most 10000 characters"),
        ("repeats", T.distinct_line_ratio(text) >= 0.8, "few repeated lines"),
        ("tokens", T.token_count(text) <= 2000, "at most 2000 tokens"),
    ]


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"
_RATIO = f"CASE WHEN len({_LINES}) = 0 THEN 1.0 ELSE len(list_distinct({_LINES})) / len({_LINES})::DOUBLE END"
_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'))"


@query(f"""WITH p AS (SELECT lang IN ('en', 'fr') AS a, n_chars > 200 AS b, n_chars BETWEEN 1 AND 10000 AS c, {_RATIO} >= 0.8 AS d, {_TOKENS} <= 2000 AS e FROM documents),
s AS (SELECT count(*) AS c0, count_if(a) AS c1, count_if(a AND b) AS c2, count_if(a AND b AND c) AS c3, count_if(a AND b AND c AND d) AS c4, count_if(a AND b AND c AND d AND e) AS c5 FROM p)
SELECT CAST(stage AS INTEGER) AS stage, name, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, description FROM s, LATERAL (VALUES
 (1, 'language', c0, c1, 'English or French'), (2, 'longer', c1, c2, 'more than 200 characters'), (3, 'size', c2, c3, 'at most 10000 characters'),
 (4, 'repeats', c3, c4, 'few repeated lines'), (5, 'tokens', c4, c5, 'at most 2000 tokens')) AS v(stage, name, before, after, description)""")
def waterfall_documents(read):
    """Rows before and after each curation stage, counted in one pass."""
    return C.waterfall(read("documents"), _document_stages())


@query(f"SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars > 200 AND n_chars BETWEEN 1 AND 10000 AND {_RATIO} >= 0.8 AND {_TOKENS} <= 2000")
def curated_documents(read):
    return C.curate(read("documents"), _document_stages()).select("doc_id")


@query(f"SELECT doc_id, {_RATIO} AS ratio FROM documents WHERE {_RATIO} >= 0.8")
def repeat_ratio_filter(read):
    ratio = T.distinct_line_ratio(F.col("text"))
    return read("documents").select("doc_id", ratio.alias("ratio")).where("ratio >= 0.8")


_MESSAGE = """CASE o_orderkey % 9 WHEN 0 THEN 'feat(Algebra/Group): add ' || o_orderkey WHEN 1 THEN 'feat: add ' || o_orderkey WHEN 2 THEN 'feat' || chr(10)
  WHEN 3 THEN 'chore.' WHEN 4 THEN 'fix(Foo): x' WHEN 5 THEN 'faet(A/B): q' WHEN 6 THEN 'Refactor (x/y): z' WHEN 7 THEN 'docs(A/B): q' ELSE '' END"""
_PREFIX = """CASE WHEN least(instr(m, ':'), instr(m, '('), instr(m, ')'), instr(m, '/')) - 1 < 0 THEN left(m, CAST(greatest(length(m) - 1, 0) AS INTEGER))
  ELSE left(m, CAST(least(instr(m, ':'), instr(m, '('), instr(m, ')'), instr(m, '/')) - 1 AS INTEGER)) END"""


@query(f"""WITH m AS (SELECT o_orderkey, {_MESSAGE} AS m FROM orders), w AS (SELECT o_orderkey, lower(regexp_replace({_PREFIX}, '^\\s+|\\s+$', '', 'g')) AS w FROM m),
t AS (SELECT o_orderkey, CASE WHEN w IN ('faet', 'feature', 'featl', 'feeat') THEN 'feat' ELSE w END AS w FROM w)
SELECT o_orderkey, CASE WHEN w IN ('chore', 'feat', 'refactor', 'fix') THEN w END AS commit_type FROM t""")
def commit_type(read):
    return read("orders").select("o_orderkey", T.commit_type(F.expr(_MESSAGE.replace("chr(10)", "'\\n'"))).alias("commit_type"))


_SIGNED = "CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' THEN '+' WHEN l_linenumber % 5 = 0 THEN '--- ' ELSE ' ' END || l_linenumber"


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_SIGNED} AS l FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l LIKE '-%' AND l NOT LIKE '---%' THEN -1 WHEN l LIKE '+%' AND l NOT LIKE '+++%' THEN 1 ELSE 0 END AS k FROM d),
n AS (SELECT *, lead(k) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) AS nxt FROM k)
SELECT l_orderkey, CAST(count_if(k = 1) AS INTEGER) AS added, CAST(count_if(k <> 0) AS INTEGER) AS total, CAST(count_if(k <> 0) - sum(CASE WHEN k = -1 AND nxt = 1 THEN 1 ELSE 0 END) AS INTEGER) AS pure, CAST(sum(k) AS INTEGER) AS net
FROM n GROUP BY l_orderkey""")
def diff_stats(read):
    """Each order's lines as a diff: returned lines removed, accepted ones added."""
    line = F.expr(_SIGNED)
    kind = F.when(line.startswith("-") & ~line.startswith("---"), -1).when(line.startswith("+"), 1).otherwise(0)
    diffs = read("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", kind.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("diff"))
    return diffs.select("l_orderkey", T.diff_stats(F.col("diff")).alias("s")).select("l_orderkey", "s.*")


_NONCODE = "'import Foo.Bar' || chr(10) || coalesce(text, '') || chr(10) || '#align x y' || chr(10) || 'reopen the' || chr(10) || 'set_option a b' || chr(10) || 'end'"


@query(f"SELECT doc_id, sha256(regexp_replace({_NONCODE}, '#align[^\\n]*(\\n|$)|set_option[^\\n]*(\\n|$)|import[^\\n]*(\\n|$)|open[^\\n]*(\\n|$)', '', 'g')) AS stripped FROM documents")
def strip_noncode(read):
    return read("documents").select("doc_id", T.content_hash(T.strip_noncode(F.expr(_NONCODE.replace("chr(10)", "'\\n'")))).alias("stripped"))


_PATH = "CASE WHEN page_id % 3 = 0 THEN 'Mathlib/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 2 = 0 THEN '.lean' ELSE '' END"


@query(f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, path, coalesce(nullif(split_part(path, '/', 2), ''), CASE WHEN contains(path, '/') THEN '' ELSE 'other' END) AS module FROM p WHERE path <> 'Mathlib.lean' AND path LIKE 'Mathlib/%' AND path LIKE '%.lean'")
def path_filter(read):
    path = F.expr(_PATH)
    return read("pages").select("page_id", path.alias("path")).where(C.kept_path(F.col("path"))).select("page_id", "path", T.module_of(F.col("path")).alias("module"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS pure, l_linenumber AS added, (l_quantity::INTEGER % 7) - 3 AS net FROM lineitem)
SELECT * FROM p WHERE pure > 0 AND (net > 0 OR (added > 2 AND net * 0.5 + added > 0)) AND pure BETWEEN 2 AND 30""")
def positive_change(read):
    p = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("pure"), F.col("l_linenumber").alias("added"), (F.col("l_quantity").cast("int") % 7 - 3).alias("net"))
    return p.where(C.positive_change(F.col("pure"), F.col("added"), F.col("net"), 2, 0.5) & C.within_changes(F.col("pure"), 2, 30))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def latest_n(read):
    """The 100 latest orders: the limit is the feature."""
    return C.latest(read("orders").select("o_orderkey", "o_orderdate"), 100, "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM orders)")
def oldest_tail(read):
    return C.oldest_tail(read("orders").select("o_orderkey", "o_orderdate"), -0.75, "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS BIGINT) AS index FROM orders")
def reindex_by_date(read):
    return C.reindex(read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "index")


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '+00:00' ELSE '+02:00' END AS date, o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS moment FROM orders)
SELECT o_orderkey, date, CAST(epoch(moment) AS BIGINT) AS instant FROM d WHERE date >= '1995-06-01'""")
def date_floor(read):
    """ISO dates with offsets compared as text, and their instants."""
    offset = F.when(F.col("o_orderkey") % 2 == 0, "+00:00").otherwise("+02:00")
    d = read("orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("date"))
    return C.since(d, "date", "1995-06-01").withColumn("instant", F.unix_timestamp(C.instant(F.col("date"))))


@query(f"SELECT doc_id, CAST({_TOKENS} AS INTEGER) AS input_tokens FROM documents WHERE {_TOKENS} <= 500")
def token_limit_dedup(read):
    """Token limit; each distinct text is counted once."""
    return C.token_limit(read("documents").select("doc_id", "text"), "text", 500).select("doc_id", "input_tokens")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 50) AS INTEGER) + 1, 50) AS bin, lo, hi FROM orders, e)
SELECT bin, lo + (hi - lo) / 50 * (bin - 1) AS low, lo + (hi - lo) / 50 * bin AS high, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def histogram(read):
    return C.histogram(read("orders"), F.col("o_totalprice"))


@query("SELECT (SELECT l_quantity FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) WHERE r = (SELECT count(*) // 2 + 1 FROM lineitem)) AS median, avg(l_quantity) AS mean, count(*) AS n FROM lineitem")
def upper_median(read):
    return C.upper_median(read("lineitem"), F.col("l_quantity"))


@query("WITH c AS (SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, min(value) OVER () AS low, max(value) OVER () AS high, CAST(sum(value * n) OVER () AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS mean FROM c")
def unit_histogram(read):
    return C.unit_histogram(read("lineitem"), F.col("l_linenumber"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def type_frequency(read):
    return C.frequency(read("events"), F.col("event_type"))


@query("SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN a IS NULL THEN 'created' WHEN b IS NULL THEN 'deleted' WHEN a <> b THEN 'renamed' ELSE 'modified' END AS value, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 <> 0 THEN url END AS a, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN url || 'x' ELSE url END AS b FROM pages) GROUP BY 1")
def change_type(read):
    rows = read("pages").select(F.expr("case when page_id % 5 <> 0 then url end").alias("a"), F.expr("case when page_id % 7 = 0 then null when page_id % 3 = 0 then url || 'x' else url end").alias("b"))
    return C.frequency(rows, T.change_type(F.col("a"), F.col("b")))


@query("SELECT o_orderkey, 'p' || o_custkey AS parent_commit_hash FROM orders WHERE o_orderkey % 4 <> 0")
def single_parent(read):
    """Commits with one parent; merges are dropped."""
    parents = F.expr("case when o_orderkey % 4 = 0 then array('p' || o_custkey, 'q') else array('p' || o_custkey) end")
    return C.single_parent(read("orders").select("o_orderkey", parents.alias("parent_commit_hash")), drop_merges=True)


@query("SELECT o_orderkey, 'c' || unnest(generate_series(1, o_orderkey % 3)) AS parent FROM orders")
def parent_expansion(read):
    parents = F.expr("transform(slice(sequence(1, 3), 1, cast(o_orderkey % 3 as int)), x -> 'c' || x)")
    return N.by_parent(read("orders").select("o_orderkey", parents.alias("parent_commit_hash"))).select("o_orderkey", "parent")


@query("""SELECT (SELECT count(*) FROM orders) AS initial_commits, (SELECT CAST(sum(o_orderkey % 3) AS BIGINT) FROM orders) AS commit_parent_pairs,
(SELECT count(*) FROM lineitem) AS file_changes, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS final_file_changes""")
def expansion_stats(read):
    parents = F.expr("slice(sequence(1, 3), 1, cast(o_orderkey % 3 as int))")
    return N.expansion_stats(read("orders").select(parents.alias("parent_commit_hash")), read("lineitem").select("l_orderkey"), read("lineitem").where("l_returnflag <> 'R'").select("l_orderkey"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS start, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE l_linenumber END AS count, CAST(l_suppkey AS INTEGER) AS new_start, l_linenumber AS new_count FROM lineitem")
def hunk_headers(read):
    old = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("@@ -"), F.col("l_partkey"))).otherwise(F.concat(F.lit("@@ -"), F.col("l_partkey"), F.lit(","), F.col("l_linenumber")))
    diff = F.concat(old, F.lit(" +"), F.col("l_suppkey"), F.lit(","), F.col("l_linenumber"), F.lit(" @@ x\n-a\n+b"))
    return N.hunk_rows(read("lineitem").select("l_orderkey", "l_linenumber", diff.alias("diff")), "diff").drop("diff")


# ---- responses ---------------------------------------------------------------------------------


def _turns(read) -> DataFrame:
    """Conversations as rows with an array of responses, in order of their turns."""
    t = read("conversations")
    one = F.struct("turn", "text", "role")
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["turn"].alias("turn"), x["text"].alias("code"), x["role"].alias("role"))).alias("responses"))


@query("SELECT DISTINCT conv_id % 50 AS commit_hash, text AS code FROM conversations WHERE text <> ''")
def distinct_code(read):
    rows = _turns(read).select((F.col("conv_id") % 50).alias("commit_hash"), "responses")
    return R.candidates(rows, "code", None)


@query("""WITH v AS (SELECT text AS code, arg_max(turn % 2 = 0, conv_id * 1000 + turn) AS ok FROM conversations WHERE conv_id % 3 <> 0 GROUP BY text),
j AS (SELECT c.conv_id, c.turn, v.ok FROM conversations c LEFT JOIN v ON c.text = v.code)
SELECT conv_id, string_agg(turn || ':' || coalesce(CAST(ok AS VARCHAR), 'false'), ',' ORDER BY turn) AS verdicts FROM j GROUP BY conv_id HAVING bool_or(ok IS NOT NULL)""")
def merge_last_wins(read):
    """Verdicts merged into nested responses: the last of a candidate wins, misses are incomplete, rows without a match go."""
    rows = _turns(read).withColumn("one", F.lit(1))
    verdicts = read("conversations").where("conv_id % 3 <> 0").select(F.lit(1).alias("one"), F.col("text").alias("code"), (F.col("turn") % 2 == 0).alias("ok"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    merged = R.merge_verdicts(rows, verdicts, ["one"], "code", "at", F.struct(F.col("ok").alias("complete")), F.struct(F.lit(False).alias("complete")))
    shown = F.transform("responses", lambda r: F.concat(r["turn"].cast("string"), F.lit(":"), r["verification_result"]["complete"].cast("string")))
    return merged.select("conv_id", F.array_join(shown, ",").alias("verdicts"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_rows(read):
    return X.pending(read("documents").select("doc_id", "lang"), read("labels"), "doc_id")


_VOTES = "WITH c AS (SELECT user_id, event_type AS v, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)"


@query(f"{_VOTES} SELECT user_id, arg_max(v, n * 1000000000 - f) AS majority FROM c GROUP BY user_id")
def majority_vote(read):
    """Most frequent event type of each user, ties to the one seen first."""
    return R.vote(read("events"), ["user_id"], "event_type", "event_id").select("user_id", "majority")


@query(f"{_VOTES} SELECT user_id, string_agg(v || '=' || n, ',' ORDER BY v) AS counter FROM c GROUP BY user_id")
def label_counter(read):
    out = R.vote(read("events"), ["user_id"], "event_type", "event_id")
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("counter")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counter"))


_GRADE = "CASE event_id % 7 WHEN 0 THEN 'unacceptable' WHEN 1 THEN 'poor' WHEN 2 THEN 'acceptable' WHEN 3 THEN 'Good' WHEN 4 THEN 'excellent' WHEN 5 THEN 'good' ELSE 'odd' END"


@query(f"""WITH g AS (SELECT user_id, {_GRADE} AS g FROM events), l AS (SELECT user_id, g, list_position(['unacceptable', 'poor', 'acceptable', 'good', 'excellent'], g) AS p FROM g)
SELECT user_id, arg_min(g, p) AS worst FROM l WHERE p > 0 GROUP BY user_id""")
def worst_grade(read):
    return R.worst(read("events").select("user_id", F.expr(_GRADE).alias("g")), ["user_id"], "g", T.GRADES)


@query(f"WITH g AS (SELECT user_id, lower({_GRADE}) AS g FROM events) SELECT user_id FROM g GROUP BY user_id HAVING count_if(g IN ('good', 'excellent')) > count_if(g IN ('poor', 'unacceptable'))")
def judgement_keep(read):
    grades = read("events").select("user_id", F.struct(F.create_map(F.col("event_id").cast("string"), F.expr(_GRADE)).alias("TaskEvaluations")).alias("r"))
    users = grades.groupBy("user_id").agg(F.collect_list("r").alias("responses"))
    return users.where(R.judged_well(F.col("responses"))).select("user_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN text WHEN turn % 4 = 2 THEN role WHEN turn % 4 = 3 THEN 'exact' ELSE 'raw' END AS best_gen_patch, role AS model FROM conversations WHERE conv_id % 2 = 0")
def flatten_best(read):
    """One row per complete response with its best patch."""
    k = F.col("turn") % 4
    response = F.struct(
        "turn", F.col("role").alias("model"), F.when(k == 1, F.col("text")).alias("best_gen_patch"), F.when(k == 2, F.col("role")).alias("gen_patch_after_robust_repair"),
        F.when(k == 3, F.lit("exact")).alias("gen_patch_after_exact_repair"), F.lit("raw").alias("gen_patch"), F.struct((F.col("conv_id") % 2 == 0).alias("complete")).alias("verification_result"),
    )
    rows = read("conversations").groupBy("conv_id").agg(F.collect_list(response).alias("responses"))
    return R.flatten_complete(rows, ["best_gen_patch", "model", "turn"]).select("conv_id", "turn", "best_gen_patch", "model")


@query("SELECT conv_id, len(list(turn) FILTER (turn % 2 = 0)) AS kept FROM conversations GROUP BY conv_id HAVING count_if(turn % 2 = 0) > 0")
def only_verified(read):
    response = F.struct("turn", F.struct((F.col("turn") % 2 == 0).alias("complete")).alias("verification_result"))
    rows = read("conversations").groupBy("conv_id").agg(F.collect_list(response).alias("responses"))
    return R.only_verified(rows).select("conv_id", F.size("responses").cast("long").alias("kept"))


@query(r"WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, string_agg('- Task ' || i || ': ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || chr(10) ORDER BY i) AS instruction FROM t GROUP BY conv_id")
def full_instruction(read):
    exercises = F.transform("responses", lambda r: F.struct(r["role"].alias("title"), r["code"].alias("instruction")))
    return _turns(read).select("conv_id", R.full_instruction(exercises).alias("instruction"))


@query("SELECT doc_id, CASE WHEN coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END, '') = '' THEN 'new file from ' || source ELSE 'edit ' || lang || ' from ' || source END AS prompt FROM documents")
def prompt_assembly(read):
    content = F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang"))
    return read("documents").select("doc_id", R.prompt("edit {content} from {source}", "new file from {source}", content, source=F.col("source")).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS grade FROM events""")
def json_extract(read):
    """Judgements parsed from fenced answers; the last block counts, answers without one give null."""
    block = F.concat(F.lit('text ```json {"x": 1} ``` more ```json {"TaskEvaluations": '), F.regexp_replace("props", r'("k": )(\d+)', '$1"$2"'), F.lit(', "FinalOverallGrade": "good"} ``` end'))
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("no judgement")).otherwise(block)
    return read("events").select("event_id", F.try_element_at(T.parse_judgement(answer)["TaskEvaluations"], F.lit("k")).alias("grade"))


#: Answers around every text, some with fences, back-quotes and line marks of their own, some without an end or any fence.
_ANSWER = """CASE turn % 6 WHEN 0 THEN 'see' || chr(10) || '```diff' || chr(10) || text || chr(10) || '```' || chr(10) || 'and ```diff x ```'
  WHEN 1 THEN 'so' || chr(10) || '```lean' || chr(10) || 'line 12 ' || text || chr(10) || 'by `simp` line 3 x' || chr(10) || '```'
  WHEN 2 THEN '```diff' || text || '` `` ```` end' || chr(10) || '```' WHEN 3 THEN 'open ```lean' || chr(10) || text || chr(10) || 'last'
  WHEN 4 THEN '```a' || chr(10) || 'x' || chr(10) || '```' || text || '```diff' || chr(10) || chr(9) || 'y  ' || chr(10) || '```' ELSE text END"""
_STRIP = r"'^\s+|\s+$', '', 'g'"


@query(f"WITH a AS (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(a, '(?s)```diff.*?```') THEN regexp_replace(regexp_extract(a, '(?s)```diff(.*?)```', 1), {_STRIP}) END AS diff FROM a")
def fence_extract(read):
    return read("conversations").select("conv_id", "turn", T.fenced_diff(F.expr(_ANSWER.replace("chr(10)", "'\\n'").replace("chr(9)", "'\\t'"))).alias("diff"))


@query(f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(CASE WHEN regexp_matches(a, '(?s)```.*```') THEN regexp_extract(a, '(?s)```.*```') WHEN contains(a, '```') THEN regexp_extract(a, '(?s)```.*') ELSE a END, {_STRIP}) AS b FROM a)
SELECT conv_id, turn, regexp_replace(coalesce(array_to_string(list_slice(string_split(b, chr(10)), 2, len(string_split(b, chr(10))) - 1), chr(10)), ''), 'line [0-9]* ', '', 'g') AS code FROM b""")
def fenced_code(read):
    return read("conversations").select("conv_id", "turn", T.fenced_code(F.expr(_ANSWER.replace("chr(10)", "'\\n'").replace("chr(9)", "'\\t'"))).alias("code"))


@query("SELECT page_id FROM pages WHERE NOT (page_id % 3 = 0)")
def circular_import(read):
    """Pages whose made-up source does not import its own module."""
    path = F.concat(F.lit("A/B"), F.col("page_id").cast("string"), F.lit(".lean"))
    other = F.when(F.col("page_id") % 3 == 0, F.col("page_id")).otherwise(-F.col("page_id") - 1)
    content = F.concat(F.lit("import C\nimport  A.B"), other.cast("string"), F.lit("\ntheorem x"))
    return read("pages").where(~T.imports_itself(path, content)).select("page_id")


@query("SELECT user_id FROM (SELECT user_id, arg_max(event_type, -event_id) AS d FROM events GROUP BY 1) WHERE d <> 'click'")
def instruction_filter(read):
    first = read("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("d"))
    rows = first.select("user_id", F.when(F.col("d") == "click", "very easy").otherwise(F.col("d")).alias("majority_difficulty"), F.lit("substantial").alias("majority_task_nature"))
    return R.instruction_kept(rows).select("user_id")


@query("SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id")
def first_exercises(read):
    rows = _turns(read).select("conv_id", F.transform("responses", lambda r: F.struct(r["turn"].alias("exercises"))).alias("responses"))
    return R.exercises_of(rows).select("conv_id", F.col("exercises").alias("turn"))


@query("SELECT conv_id, turn, role || '-x' AS model, CAST('0.' || turn AS DOUBLE) AS temperature FROM conversations")
def file_name_metadata(read):
    path = F.concat(F.lit("/out/2024__in__"), F.col("role"), F.lit("-x__0."), F.col("turn").cast("string"), F.lit(".jsonl"))
    rows = read("conversations").select("conv_id", "turn", R.metadata_from_name(path).alias("m"))
    return rows.select("conv_id", "turn", "m.model", "m.temperature")


@query("SELECT d.doc_id AS commit_hash, d.lang AS gold_diff, d.source AS content_before, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0")
def judged_and_verified(read):
    docs = read("documents").select(F.col("doc_id").alias("commit_hash"), F.col("lang").alias("gold_diff"), F.col("source").alias("content_before"), "n_chars")
    keys = docs.drop("n_chars")
    judged = keys.join(read("labels").where("toxic = 0").withColumnRenamed("doc_id", "commit_hash"), "commit_hash").select("commit_hash", "gold_diff", "content_before", "quality")
    return R.judged_and_verified(docs, judged)


@query("SELECT CAST(count_if(quality = 1) AS DOUBLE) / count(*) AS kept FROM labels")
def kept_ratio(read):
    return read("labels").agg(R.ratio_of(F.count_if(F.col("quality") == 1), F.count(F.lit(1))).alias("kept"))


# ---- store -------------------------------------------------------------------------------------


def _files(read) -> DataFrame:
    d = read("documents").select(F.col("source").alias("commit_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("rel_path"), F.lit("regular").alias("type"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    p = read("pages").select(F.lit("pages").alias("commit_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("rel_path"), F.lit("symlink").alias("type"), F.col("url").cast("binary").alias("content"))
    return d.unionByName(p)


_FILES = "f AS (SELECT source AS commit_id, 'd/' || doc_id AS rel_path, 'regular' AS type, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS size FROM documents UNION ALL SELECT 'pages', 'p/' || page_id, 'symlink', sha256(url), octet_length(encode(url)) FROM pages)"


@query(f"WITH {_FILES} SELECT commit_id, rel_path, hash, type FROM f")
def sha_snapshot(read):
    return S.snapshot(_files(read))


@query(f"WITH {_FILES} SELECT DISTINCT hash, substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS path FROM f WHERE hash NOT IN (SELECT hash FROM f WHERE commit_id = 'src0')")
def store_new_contents(read):
    """Contents that a store filled from one source lacks, each once, with their places."""
    files = _files(read)
    store = S.snapshot(files.where("commit_id = 'src0'")).select("hash").distinct()
    return S.absent(files, store).select("hash", "path")


@query(f"WITH {_FILES}, h AS (SELECT hash, count(*) AS n, max(size) AS size FROM f GROUP BY hash) SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(n * size) AS BIGINT) AS logical_bytes, count(*) AS distinct_files, CAST(sum(size) AS BIGINT) AS stored_bytes, CAST(sum(n * size) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS ratio FROM h")
def store_ratio(read):
    return S.sizes(_files(read))


@query(f"WITH {_FILES}, s AS (SELECT DISTINCT hash FROM f WHERE commit_id <> 'src1') SELECT commit_id, count(*) AS files, count_if(s.hash IS NULL) AS failed, count_if(s.hash IS NULL) <= 10 AS restored FROM f LEFT JOIN s ON s.hash = f.hash GROUP BY commit_id")
def restore_join(read):
    """Restore of every snapshot from a store that one source is not in."""
    files = _files(read)
    store = files.where("commit_id <> 'src1'").select(T.content_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
    return S.restore_summary(S.snapshot(files), store)


@query("SELECT user_id, arg_max(event_type, event_id) AS status, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'view'")
def status_upsert(read):
    """Latest status of each key after an upsert, views not counted as processed."""
    e = read("events").select("user_id", F.col("event_type").alias("status"), "event_id")
    out = S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")
    return out.where("status <> 'view'").select("user_id", "status", "event_id")


@query("SELECT o_orderkey AS commit_id FROM orders WHERE o_orderstatus <> 'F'")
def build_queue(read):
    o = read("orders").select(F.col("o_orderkey").cast("string").alias("commit_id"), F.when(F.col("o_orderstatus") == "F", "collapsed").otherwise("pending").alias("status"))
    return S.to_build(o.select("commit_id"), o).select(F.col("commit_id").cast("long").alias("commit_id"))


@query("SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1")
def build_summary(read):
    return S.build_summary(read("orders").select(F.col("o_orderstatus").alias("outcome")))


@query("SELECT doc_id, lang, NULL::BIGINT AS page_id, NULL::VARCHAR AS url FROM documents UNION ALL SELECT NULL, NULL, page_id, url FROM pages")
def union_by_name(read):
    return read("documents").select("doc_id", "lang").unionByName(read("pages").select("page_id", "url"), allowMissingColumns=True)


_LOG = "CASE WHEN turn % 3 = 0 THEN '  Error: ' || role ELSE role END || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'WARNING x' ELSE 'ok' END"


@query("SELECT role, count(*) AS n, count_if(turn % 3 <> 0 AND conv_id % 5 <> 0) AS passed, count_if(turn % 3 <> 0 AND conv_id % 5 <> 0 AND turn % 2 <> 0) AS completed, CAST(count_if(turn % 3 <> 0 AND conv_id % 5 <> 0) AS DOUBLE) / count(*) AS pass_rate, CAST(count_if(turn % 3 <> 0 AND conv_id % 5 <> 0 AND turn % 2 <> 0) AS DOUBLE) / count(*) AS complete_rate FROM conversations GROUP BY role")
def compiler_output(read):
    """Verdicts from compiler output, and pass rates by role."""
    lines = T.compiler_lines(F.expr(_LOG.replace("chr(10)", "'\\n'")))
    checked = read("conversations").select("role", T.verdict(lines, F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)).alias("v")).select("role", "v.*")
    return S.check_rates(checked, ["role"])


@query("SELECT a.s_suppkey AS s_suppkey, levenshtein(a.s_name, p.p_name) AS distance FROM supplier a JOIN part p ON a.s_suppkey = p.p_partkey")
def edit_distance(read):
    j = read("supplier").join(read("part"), F.col("s_suppkey") == F.col("p_partkey"))
    return j.select("s_suppkey", F.levenshtein("s_name", "p_name").cast("long").alias("distance"))


@query("SELECT s_suppkey, trim(lower(s_name), ' ' || chr(10) || chr(9) || '·') AS line FROM supplier")
def normal_lines(read):
    return read("supplier").select("s_suppkey", T.normal_line(F.concat(F.lit(" ·\t"), F.col("s_name"), F.lit("· \n"))).alias("line"))


# ---- progress, verification and smaller functions ----------------------------------------------


@query("SELECT user_id % 40 AS key, arg_max(event_type, event_id) FILTER (event_id % 3 = 0 OR user_id % 40 < 20) AS value FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1 AND user_id % 40 < 20 GROUP BY 1")
def progress_upsert(read):
    """Progress keys replaced by newer values, of some of the keys only."""
    e = read("events").select((F.col("user_id") % 40).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("updated_at"))
    newest = lambda rows: rows.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), "updated_at").alias("x")).select(F.col("key").cast("string").alias("key"), "x.*")
    old, new = newest(e.where("updated_at % 3 = 0")), newest(e.where("updated_at % 3 = 1 and key < 20"))
    # The newer of both by time, as the ledger's writers would have it.
    late = new.join(old.select("key", F.col("updated_at").alias("was")), "key", "left").where("was is null or updated_at > was").drop("was")
    return X.upsert_progress(old, late, only=[str(k) for k in range(20)]).select(F.col("key").cast("long").alias("key"), "value")


_SIDES = "list_filter(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l, i: i % 2 = {k} AND NOT starts_with(l, '{sign}{sign}')), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"
_SHARE = "CASE WHEN len({x}) = 0 THEN 1.0 ELSE len(list_distinct({x})) / len({x})::DOUBLE END"


@query(f"SELECT doc_id, {_SHARE.format(x=_SIDES.format(k=1, sign='+'))} AS added, {_SHARE.format(x=_SIDES.format(k=0, sign='-'))} AS removed FROM documents")
def diff_sides(read):
    """Share of distinct lines among the added and among the removed lines of a diff made of each text."""
    diff = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.concat(F.when(i % 2 == 0, "+").otherwise("-"), l)), "\n")
    return read("documents").select("doc_id", T.repeat_ratios(diff).alias("r")).select("doc_id", "r.added", "r.removed")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text FROM documents")
def diff_unsigned(read):
    """Lines of a diff without their signs give the text again."""
    signed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.concat(F.when(i % 2 == 0, "+").otherwise("-"), l))
    return read("documents").select("doc_id", T.content_hash(F.array_join(T.diff_lines(F.array_join(signed, "\n")), "\n")).alias("text"))


def _stub(code: str, folder: str) -> dict:
    """A checker that needs no toolchain: a text with "qu" is an error, one with a line break a warning."""
    said = [{"type": "error", "message": "qu"}] * ("qu" in code) + [{"type": "warning", "message": "break"}] * ("\n" in code)
    ok = "qu" not in code
    return {"parsed_output": said, "raw_output": "", "raw_stderr": "", "returncode": 0, "pass": ok, "complete": ok and "\n" not in code, "lean_output": None, "system_error": None}


def _blob(digest: str) -> bytes:
    if digest.startswith("miss"):
        raise KeyError(digest)
    return digest.encode()


@query("""WITH r AS (SELECT conv_id % 9 AS c, text FROM conversations WHERE text <> '')
SELECT 'c' || c AS commit_hash, CASE WHEN c % 3 = 1 THEN 'restore_failed' WHEN c % 3 = 2 THEN 'failed_verify' ELSE 'ready' END AS status, count(*) AS n,
count_if(c % 3 = 0 AND NOT contains(text, 'qu')) AS passed, count_if(c % 3 = 0 AND NOT contains(text, 'qu') AND NOT contains(text, chr(10))) AS completed FROM r GROUP BY c""")
def commit_checks(read):
    """Records checked in restored worktrees: one third cannot be restored, one third does not build."""
    records = read("conversations").select(F.concat(F.lit("c"), (F.col("conv_id") % 9).cast("string")).alias("commit_hash"), F.col("text").alias("code"))
    commits = records.select(F.col("commit_hash").alias("commit_id")).distinct()
    kind = F.substring("commit_id", 2, 9).cast("int") % 3
    snapshots = commits.select("commit_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i")).select(
        "commit_id", F.concat(F.when((kind == 2) & (F.col("i") == 1), "broken/f").otherwise("src/f"), F.col("i")).alias("rel_path"),
        F.concat(F.when(kind == 1, "miss").otherwise("h"), F.col("i")).alias("hash"), F.lit("regular").alias("type"),
    )
    done = V.verify(records, snapshots, V.Hooks(_blob, lambda folder: "it is broken" if os.path.exists(f"{folder}/broken") else None, _stub), 50)
    ok = lambda f: F.count_if(F.coalesce(F.col(f"verification_result.{f}"), F.lit(False)))
    return done.groupBy("commit_hash", "status").agg(F.count(F.lit(1)).alias("n"), ok("pass").alias("passed"), ok("complete").alias("completed"))


# ---- sequential algorithms, over source files made of whole texts, against what their lines must give ---------------


def _lean(read) -> DataFrame:
    return files(read("documents"))


def _diffed(read) -> DataFrame:
    return _lean(read).withColumn("diff", U.unified_diff(F.col("before"), F.col("after")))


def _broken(diff) -> Column:
    """A diff with wrong numbers and altered context."""
    return F.regexp_replace(F.regexp_replace(diff, r"@@ -\d+,\d+ \+\d+,\d+ @@", "@@ -1,1 +1,1 @@"), "(?m)^ theorem", " THEOREM")


@query(f"WITH {FILES} SELECT doc_id, sha256(code) AS code FROM files")
def comment_strip(read):
    return _lean(read).select("doc_id", T.content_hash(U.strip_comments(F.col("before"))).alias("code"))


@query(f"""WITH {FILES} SELECT doc_id, CAST(replaced + 1 AS INTEGER) AS added, CAST(2 * replaced + removed + 1 AS INTEGER) AS total,
CAST(replaced + removed + 1 - CAST(last AS INTEGER) AS INTEGER) AS pure, CAST(1 - removed AS INTEGER) AS net FROM edits""")
def filtered_diff(read):
    return _lean(read).select("doc_id", U.filtered_diff(F.col("before"), F.col("after")).alias("d")).select("doc_id", "d.added", "d.total", "d.pure", "d.net")


@query(f"WITH {FILES} SELECT doc_id, sha256(after) AS after FROM files")
def diff_round_trip(read):
    """Unified diffs applied to their old side give the new side."""
    return _diffed(read).select("doc_id", T.content_hash(U.apply_diff(F.col("before"), F.col("diff"))).alias("after"))


@query(f"WITH {FILES} SELECT doc_id, sha256(after) AS after FROM files")
def moved_diffs(read):
    """Diffs whose context differs in white space, applied to a text that has grown by 300 lines in front of it."""
    front = F.repeat(F.lit("-- before\n"), 300)
    loose = F.regexp_replace("diff", "(?m)^ theorem ", " theorem   ")
    done = U.apply_diff(F.concat(front, F.col("before")), loose)
    return _diffed(read).select("doc_id", T.content_hash(F.substr(done, F.length(front) + 1)).alias("after"))


#: Repair may move or double the blank lines around an insertion, so these are left out of the comparison.
_DENSE = "sha256(regexp_replace(after, '\\n+', chr(10), 'g'))"


def _dense(content) -> Column:
    return T.content_hash(F.regexp_replace(content, "\n+", "\n"))


@query(f"WITH {FILES} SELECT doc_id, {_DENSE} AS after FROM files")
def diff_repair(read):
    """Diffs with wrong numbers and altered context, repaired and applied."""
    d = _diffed(read).select("doc_id", "before", U.repair_diff(F.col("before"), _broken(F.col("diff")))["patch"].alias("patch"))
    return d.select("doc_id", _dense(U.apply_diff(F.col("before"), F.col("patch"))).alias("after"))


@query("SELECT lang AS model, count(*) AS total, count_if(doc_id % 3 <> 0) AS success, count_if(doc_id % 3 = 0) AS failure, CAST(count_if(doc_id % 3 <> 0) AS DOUBLE) / count(*) AS rate FROM documents GROUP BY lang")
def repair_stats(read):
    """Share of patches that could be repaired, by language as model; every third is about another file."""
    other = "@@ -1,1 +1,1 @@\n-wholly other words stand here\n+x"
    rows = _diffed(read).select(F.col("lang").alias("model"), F.col("before").alias("content_before"), F.when(F.col("doc_id") % 3 == 0, other).otherwise(_broken(F.col("diff"))).alias("gen_patch"))
    return R.repair_stats(R.repaired(rows)).select("model", "total", "success", "failure", "rate")


@query()
def scattered_edits(read):
    pairs = read("supplier").join(read("part"), F.col("s_suppkey") == F.col("p_partkey"))
    return pairs.select("s_suppkey", U.edit_runs(F.col("s_name"), F.col("p_name")).alias("e"), U.good_edit(F.col("s_name"), F.col("p_name")).alias("good")).select("s_suppkey", "e.*", "good")


@query("SELECT s_suppkey, CAST(levenshtein(s_name, p_name) AS INTEGER) AS total FROM supplier JOIN part ON s_suppkey = p_partkey")
def edit_totals(read):
    """Length of the shortest edit script of each pair."""
    pairs = read("supplier").join(read("part"), F.col("s_suppkey") == F.col("p_partkey"))
    return pairs.select("s_suppkey", U.edit_runs(F.col("s_name"), F.col("p_name"))["total"].alias("total"))


@query(f"""WITH {FILES}, {DEFINED}, c AS (SELECT doc_id, kind, name, name <> 'g' AND (i // 4 % 5 = 1 AND i + 2 < n OR i // 4 % 5 = 3 AND i + 1 < n) AS changed FROM defined JOIN files USING (doc_id))
SELECT doc_id, CAST(count_if(kind = 'def') AS DOUBLE) AS original_total_def_count, CAST(count_if(kind = 'theorem') - 1 AS DOUBLE) AS original_total_theorem_count, CAST(count_if(kind = 'def') AS DOUBLE) AS new_total_def_count,
CAST(count_if(kind = 'theorem') AS DOUBLE) AS new_total_theorem_count, CAST(0 AS DOUBLE) AS added_def_count, CAST(1 AS DOUBLE) AS added_theorem_count, CAST(count_if(kind = 'def' AND changed) AS DOUBLE) AS changed_def_count,
CAST(count_if(kind = 'theorem' AND changed) AS DOUBLE) AS changed_theorem_count, CAST(count_if(kind = 'def' AND changed) AS DOUBLE) AS changed_def_line_count, CAST(count_if(kind = 'theorem' AND changed) AS DOUBLE) AS changed_theorem_line_count,
CAST(count_if(kind = 'theorem' AND changed) > 0 AS DOUBLE) AS avg_changed_theorem_line_count, CAST(1 AS DOUBLE) AS avg_added_theorem_line_count FROM c GROUP BY doc_id""")
def definition_stats(read):
    s = _lean(read).select("doc_id", U.pair_stats(F.col("before"), F.col("after")).alias("s"))
    names = [f"{side}_total_{k}_count" for side in ("original", "new") for k in ("def", "theorem")] + [f"{c}_{k}_{n}" for c, n in (("added", "count"), ("changed", "count"), ("changed", "line_count")) for k in ("def", "theorem")]
    return s.select("doc_id", *[F.col(f"s.{n}") for n in (*names, "avg_changed_theorem_line_count", "avg_added_theorem_line_count")])


@query(f"""WITH {FILES}, {DEFINED}, k AS (SELECT doc_id, count_if(kind = 'theorem') AS t FROM defined GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN f.doc_id % 3 = 0 THEN 'A' || f.doc_id % 4 ELSE 'other' END AS module, CAST(len(regexp_extract_all(before, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS INTEGER) AS input_tokens, 0 AS instruction_tokens, CAST(t AS DOUBLE) AS new_total_theorem_count FROM files f JOIN k ON k.doc_id = f.doc_id""")
def joined_statistics(read):
    """Module, tokens and statistics of definitions joined to rows that had some of these columns already."""
    rows = _lean(read).select("doc_id", F.col("before").alias("content_before"), F.col("after").alias("content_after"), F.lit(-1.0).alias("new_total_theorem_count"),
                              F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Root/A"), (F.col("doc_id") % 4).cast("string"), F.lit("/x.lean"))).otherwise("x.lean").alias("file_path_after"))
    return N.with_statistics(rows, "doc_id").select("doc_id", "module", "input_tokens", "instruction_tokens", "new_total_theorem_count")


@query(f"WITH {FILES}, {DEFINED} SELECT doc_id, kind, keyword, name FROM defined")
def definition_list(read):
    return _lean(read).select("doc_id", F.explode(U.definitions(F.col("after"))).alias("d")).select("doc_id", "d.kind", "d.keyword", "d.name")


@query(f"WITH {FILES} SELECT doc_id, {_DENSE} AS content FROM files")
def patch_responses(read):
    """Model answers with a broken diff, parsed, repaired and applied."""
    answer = F.concat(F.lit("Here:\n```diff\n"), _broken(F.col("diff")), F.lit("\n```\nThat is all."))
    return _diffed(read).select("doc_id", _dense(U.patch_response(F.col("before"), answer)["best_gen_content"]).alias("content"))


_TOLD = "regexp_replace(regexp_replace(coalesce(text, ''), '[*#-]', '_'{g}), '(?i)exercise', '_'{g})"


@query(f"""WITH t AS (SELECT doc_id, {_TOLD.format(g=", 'g'")} AS t FROM documents)
SELECT doc_id, CAST(x AS INTEGER) AS num, 'Title ' || doc_id AS title, '-1 +' || x AS hunk_span, 'Feature' AS task_category, 'Adding' AS focus, CASE x WHEN 1 THEN 'Easy' ELSE 'Hard' END AS difficulty, 'Substantial' AS task_nature,
regexp_replace('Do it. ' || t, {_STRIP}) AS instruction
FROM t, (VALUES (1), (2)) AS v(x)""")
def exercise_list(read):
    """Two exercises in an answer, each with a whole text as its statement."""
    told = F.expr(_TOLD.format(g=""))
    one = lambda n, level: F.concat(
        F.lit(f"\n\n### Exercise {n}: Title "), F.col("doc_id"), F.lit(f"\n- **Diff Hunk Span:** @@ -1 +{n} @@\n- **Task Category:** Feature\n- **Focus:** Adding\n- **Difficulty:** {level}\n- **Task Nature:** Substantial\n- **Problem Statement:** Do it. "), told, F.lit("\n")
    )
    answer = F.concat(F.lit("Thoughts first.\nExercises in Lean"), one(1, "Easy"), one(2, "Hard"))
    return read("documents").select("doc_id", F.explode(U.exercises(answer)).alias("x")).select("doc_id", "x.*")


@query(f"""WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replaced + 1 ELSE n - removed + 1 END AS added, CASE WHEN doc_id % 2 = 0 THEN 2 * replaced + removed + 1 ELSE n - removed + 1 END AS total,
TRUE AS complete, CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'created' END AS change_type FROM edits""")
def mined_changes(read):
    """File changes split by hunks and new files cut into chunks: their statistics add up, and a part ends in the whole new file."""
    rows = _diffed(read)
    modified = F.col("doc_id") % 2 == 0
    body = F.regexp_replace("after", "\n(?!$)", "\n+")
    size = F.size(F.split("after", "\n")) - 1
    raw = rows.select(
        F.col("doc_id").cast("string").alias("commit_hash"), F.lit("A <a@b>").alias("author"), F.lit("feat(A/B): x").alias("message"), F.lit("2024-01-01T00:00:00+00:00").alias("date"),
        F.array(F.lit("p")).alias("parent_commit_hash"), F.lit(None).cast("string").alias("toolchain_content"), F.when(modified, "A.lean").alias("file_path_before"), F.lit("A.lean").alias("file_path_after"),
        F.when(modified, F.col("before")).alias("content_before"), F.col("after").alias("content_after"),
        F.when(modified, F.regexp_extract("diff", r"(?s)@@.*", 0)).otherwise(F.concat(F.lit("@@ -0,0 +1,"), size.cast("string"), F.lit(" @@\n+"), body)).alias("gold_diff"), F.lit(False).alias("copied"),
    )
    parts = N.file_changes(N.classified(raw).drop("copied"), 5).join(rows.select(F.col("doc_id").cast("string").alias("commit_hash"), F.col("after").alias("whole")), "commit_hash")
    out = parts.groupBy(F.col("commit_hash").cast("long").alias("doc_id")).agg(F.sum("added_lines").alias("added"), F.sum("total_changes").alias("total"), F.bool_or(F.col("content_after") == F.col("whole")).alias("complete"), F.min("change_type").alias("change_type"))
    return out
