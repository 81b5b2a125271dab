"""History, vector cache, journal, federation, resolution and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as FP
from ..operators import evaluate, extraction, federation, history, journal, resolution, vectors
from ..session import table
from . import relations as R


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of every member: all rows' earliest and latest generation; the new one under shifted paths for a part."""
    f = R.files(spark, d).select("member", "path", F.col("revision").alias("oid"), F.coalesce("language", F.lit("none")).alias("mode"), "id")
    old = f.where(F.col("id") % 11 != 0).select("member", "path", "oid", "mode")
    moved = F.when(F.col("id") % 7 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    new = f.where(F.col("id") % 13 != 0).select("member", moved.alias("path"), F.when(F.col("id") % 5 == 0, F.sha2(F.concat(F.coalesce("oid", F.lit("")), F.lit("x")), 256)).otherwise(F.col("oid")).alias("oid"), "mode")
    return old, new


def tree_compare(spark: SparkSession, d: str) -> DataFrame:
    return history.tree_compare(*_trees(spark, d), by=["member"]).groupBy("member", "change").agg(F.count("*").alias("n"))


def scope_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.scope_changes(history.tree_compare(*_trees(spark, d), by=["member"]), "src/").groupBy("change").agg(F.count("*").alias("n"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = R.files(spark, d)
    path = F.concat_ws(":", "member", "path")
    old = f.where(F.col("id") % 9 != 0).select(path.alias("path"), "revision", "status", "bytes")
    new = f.where(F.col("id") % 10 != 0).select(path.alias("path"), F.when(F.col("id") % 4 == 0, F.substring("revision", 1, 20)).otherwise(F.col("revision")).alias("revision"), F.when(F.col("id") % 6 == 0, "cancelled").otherwise(F.col("status")).alias("status"), "bytes")
    return old, new


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return history.change_feed(*_scans(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def session_end(spark: SparkSession, d: str) -> DataFrame:
    old, new = _scans(spark, d)
    return journal.session_changes(old.select("path", "revision", "status"), new.select("path", "revision", "status")).groupBy("kind").agg(F.count("*").alias("n"))


def change_retention(spark: SparkSession, d: str) -> DataFrame:
    """Commits a day as windows: the newest days with at most 4,096 rows."""
    t = table(spark, d, "commits").groupBy(F.date_format("observed_at", "yyyy-MM-dd").alias("generation")).agg(F.count("*").alias("rows"))
    return history.retained(t).select("generation", "rows")


def observations_since(spark: SparkSession, d: str) -> DataFrame:
    """Whether each member has every window from 0 to 2 with a known number of failures."""
    c = table(spark, d, "coverage").where("generation > 0 AND generation <= 2")
    return c.groupBy("member").agg(((F.countDistinct("generation") == 2) & (F.min(F.col("parse_failures").isNotNull().cast("int")) == 1)).alias("complete"))


def blame(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring definitions of the same kind in a file."""
    x = table(spark, d, "definitions").select("file_id", "id", "kind").distinct()
    w = Window.partitionBy("file_id").orderBy("id")
    return history.blame_runs(x.select("file_id", F.row_number().over(w).alias("line"), F.col("kind").alias("oid")), ["file_id"]).withColumnRenamed("oid", "kind")


def correspond(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "definitions").select("id", F.col("file_id").alias("file"), F.concat_ws("/", "kind", "name").alias("key"), F.col("span_end").cast("string").alias("digest")).distinct()
    new = x.where("id % 8 <> 0").select((F.col("id") + 0).alias("id"), "file", F.when(F.col("id") % 5 == 0, F.concat("key", F.lit("2"))).otherwise(F.col("key")).alias("key"), F.when(F.col("id") % 3 == 0, F.concat("digest", F.lit("+"))).otherwise(F.col("digest")).alias("digest"))
    return history.correspond(x, new).groupBy("state").agg(F.count("*").alias("n"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents by how many documents have them."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(history.line_fingerprints(F.col("text")))).alias("h"))
    return t.groupBy("h").agg(F.count("*").alias("documents")).groupBy("documents").agg(F.count("*").alias("lines"))


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Line changes between each document and the same without every seventh line."""
    return history.line_diff(line_pairs(spark, d))


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    less = F.array_join(F.filter(lines, lambda x, i: i % 7 != 6), "\n")
    return t.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("old"), less.cast("binary").alias("new"))


def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = vectors.normalise(t, 64)
    return n.select("id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", 64), 6).alias("last"))


def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "vector_cache")
    return vectors.validity(t, 64).groupBy("state").agg(F.count("*").alias("n"))


def vector_cache_put(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "vector_cache").select("key", "touched")
    return vectors.put(t.where("touched % 3 <> 0"), t.where("touched % 3 = 0"), 500)


def prepare_missing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "vector_cache").select("key", "touched")
    return vectors.missing(t, t.where("touched % 2 = 0"))


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "definitions").select("file_id", F.col("id").alias("nth"), (F.col("span_end") - F.col("span_start")).alias("tokens")).groupBy("file_id", "nth").agg(F.max("tokens").alias("tokens"))
    return vectors.batches(t, "file_id").groupBy("file_id").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("inputs"))


def fair_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("root"), F.col("event_id").alias("arrived"), (F.col("event_type") == "error").alias("background"))
    return vectors.fair_turns(e).select("arrived", "slot")


def debounce(spark: SparkSession, d: str) -> DataFrame:
    return journal.debounce(table(spark, d, "events"), ["user_id"], quiet_ms=3_600_000, longest_ms=7_200_000).select("user_id", "started", "ended", "events")


def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    return journal.unexpired(last.join(F.broadcast(now)), F.col("now"), 86_400).select("user_id")


def bounded_queue(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour that a queue of 32 an hour takes and drops."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_id")
    return vectors.offer(e, ["hour"], ["event_id"], 32)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "server").when(F.col("event_type") == "click", "delivery").when(F.col("event_type") == "error", "malformed").otherwise("other")
    return table(spark, d, "events").select(F.col("user_id").alias("request_id"), kind.alias("kind"), (F.col("value") > 10).alias("complete"), F.floor("value").cast("long").alias("tokens"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return journal.audit(_requests(spark, d))


def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return journal.audit_totals(journal.audit(_requests(spark, d)))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Definitions as changes, regions as what was emitted."""
    c = table(spark, d, "definitions").select(F.col("file_id").alias("session"), "id", F.col("file_id").alias("path"), "revision", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.lit(2).alias("at")).distinct()
    m = table(spark, d, "region_spans").select(F.col("file_id").alias("session"), F.col("file_id").alias("path"), "revision", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("definition").isNotNull().alias("source"), F.lit(1).alias("at"))
    return journal.ledger(c, m)


def lane_trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("lane"), F.col("event_id").alias("rank"), F.col("event_id").alias("identity"))
    t = journal.lane_trace(e, 16)
    return t.select("request_id", "lane", "hits", F.array_join(F.transform("first", lambda x: x["identity"].cast("string")), ",").alias("first"))


def journal_segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", F.col("event_id").alias("id"), F.length("props").alias("size"))
    return journal.journal_segments(e, 5000, 40000)


def agent_session_summary(spark: SparkSession, d: str) -> DataFrame:
    verb = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "show").when(F.col("event_type") == "signup", "ctx").otherwise("refs")
    e = table(spark, d, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), verb.alias("verb"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.get_json_object("props", "$.k").alias("text"),
    )
    return journal.agent_sessions(e.withColumn("hits", F.col("k") % 10))


def agent_adoption(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "used").when(F.col("event_type") == "error", "escaped")
    return journal.adoption(table(spark, d, "events").select((F.col("user_id") % 10).alias("harness"), kind.alias("kind")))


def _member_hits(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d).where("member IS NOT NULL")
    ranked = f.select("member", "id", F.row_number().over(Window.partitionBy("member").orderBy("id")).alias("rank"))
    return ranked.where("rank <= 1000")


def ws_merge(spark: SparkSession, d: str) -> DataFrame:
    return federation.merge(_member_hits(spark, d), "harbor-core").select("member", "id", "place")


def ws_widen(spark: SparkSession, d: str) -> DataFrame:
    return federation.widen(R.files(spark, d).where("member IS NOT NULL"), "no-such-member").groupBy("member").agg(F.count("*").alias("hits"))


def ws_scope(spark: SparkSession, d: str) -> DataFrame:
    members = [r[0] for r in table(spark, d, "coverage").select("member").distinct().orderBy("member").collect()]
    chosen, _ = federation.scope(["ws:all", "slow", "query"], members, members[0] if members else "")
    return R.files(spark, d).where(F.col("member").isin(chosen)).groupBy("member").agg(F.count("*").alias("files"))


def ws_coverage(spark: SparkSession, d: str) -> DataFrame:
    return federation.coverage(_member_hits(spark, d), table(spark, d, "coverage"), 50)


def ws_parent_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d)
    hits = f.select("id", F.concat_ws(":", "member", "path").alias("path"), "revision")
    own = _scans(spark, d)[1].select("path", "revision")
    return federation.parent_fallback(hits, own).groupBy("state").agg(F.count("*").alias("n"))


def ordered_chain(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as implementations, ordered by balance in hundreds."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("base"), F.col("s_name").alias("implementation"), F.floor(F.col("s_acctbal") / 1000).alias("priority"))
    return resolution.ordered_chain(s)[0]


def chain_prepare(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("base"), F.col("s_name").alias("implementation"), F.when(F.col("s_acctbal") > -900, F.floor("s_acctbal")).alias("priority"), (F.col("s_suppkey") % 5 != 0).alias("active"))
    return resolution.prepare_chains(s)[1]


def php_class_index(spark: SparkSession, d: str) -> DataFrame:
    x = resolution.class_index(table(spark, d, "definitions"))
    return x.select("key", F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").alias("classes"))


def php_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "definitions").select("id", "file_id", "name", "kind", "span_start", "span_end").distinct()
    # a class's own name stands for a use of it
    got = resolution.class_names(x.where("kind = 'class'"), resolution.class_index(x), x)
    return got.select("id", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"), "owner")


def php_extends_edges(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "definitions").select("id", "name", "kind", "container").distinct()
    c = x.select("id", F.col("container").alias("parent"), (F.col("id") % 17 == 0).alias("conditional"), (F.col("id") % 19 != 0).alias("complete"))
    edges, issues = resolution.extends_edges(resolution.parent_status(c, resolution.class_index(x)))
    return edges.select("source", F.lit("edge").alias("what")).unionByName(issues.select("source", F.col("issue").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def alias_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "definitions").select("name").distinct()
    return x.select("name", resolution.alias_name([("Active", "Finder"), ("Safe", "Repo")], F.concat(F.lit("Active\\"), "name")).alias("canonical"))


def extract_syntax(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d).where("revision IS NOT NULL").groupBy("revision").agg(F.min("path").alias("path"))
    b = table(spark, d, "contents").join(f.hint("shuffle_hash"), "revision")
    return extraction.extract_all(b, columns=("status", "fact", "kind")).groupBy("fact", "kind", "status").agg(F.count("*").alias("n"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Members as tasks: their class definitions' files are relevant, their files by id the hits."""
    x = R.definitions(spark, d)
    labels = x.where("kind = 'class'").select(F.col("member").alias("task"), F.col("file_id").cast("string").alias("path"))
    hits = _member_hits(spark, d).select(F.col("member").alias("task"), F.col("id").cast("string").alias("path"), "rank")
    return evaluate.recall(labels, hits)


def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a body's regions cover it."""
    c = table(spark, d, "contents").select(F.col("revision").alias("id"), F.lit(0).cast("long").alias("start"), F.length("bytes").cast("long").alias("end"))
    s = table(spark, d, "region_spans").select(F.col("revision").alias("id"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).distinct()
    return evaluate.span_coverage(c, s)


def _graded(lines: DataFrame) -> DataFrame:
    t = lines.select("doc_id", "source", F.posexplode("lines").alias("line", "text"))
    frozen = t.select(F.col("doc_id").cast("string").alias("path"), "line", "text")
    emitted = t.select(F.lower(F.trim("source")).alias("task"), F.col("doc_id").cast("string").alias("path"), "line", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"))
    return evaluate.grade(emitted, frozen)


def grade_task(spark: SparkSession, d: str) -> DataFrame:
    """Every line of each document."""
    return _graded(table(spark, d, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines")))


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "coverage").select("member", "total_files", "parse_failures")
    return evaluate.usage(c, "member", ["total_files", "parse_failures"])


def limits_exceeded(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.exceeded(table(spark, d, "coverage").select("member", "generation", "total_files", "indexed_bytes"), {"total_files": 20, "indexed_bytes": 100_000}).select("member", "generation", "exceeded")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(table(spark, d, "events"), "event_type", "value", "event_id")


def path_encode(spark: SparkSession, d: str) -> DataFrame:
    enc = F.udf(lambda p: None if p is None else FP.encode_path(p.encode()), "string", useArrow=True)
    return R.files(spark, d).select("id", enc("path").alias("encoded"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_compare, scope_changes, change_feed, session_end, change_retention, observations_since, blame, correspond, fingerprints, line_diff, vector_normalise, vector_validate,
        vector_cache_put, prepare_missing, batch_plan, fair_schedule, debounce, ttl_expiry, bounded_queue, audit, audit_totals, ledger, lane_trace, journal_segments, agent_session_summary,
        agent_adoption, ws_merge, ws_widen, ws_scope, ws_coverage, ws_parent_fallback, ordered_chain, chain_prepare, php_class_index, php_names, php_extends_edges, alias_names,
        extract_syntax, recall_at_k, span_coverage, grade_task, usage_rollup, limits_exceeded, latency_percentiles, path_encode,
    )
}

_TREES = f"""WITH {R.FILES},
o AS (SELECT member, path, revision AS oid, coalesce(language, 'none') AS mode FROM f WHERE id % 11 <> 0),
n AS (SELECT member, CASE WHEN id % 7 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN id % 5 = 0 THEN sha256(coalesce(revision, '') || 'x') ELSE revision END AS oid, coalesce(language, 'none') AS mode FROM f WHERE id % 13 <> 0),
j AS (SELECT coalesce(o.member, n.member) AS member, coalesce(o.path, n.path) AS path, o.oid AS oo, o.mode AS om, n.oid AS no, n.mode AS nm, o.path IS NOT NULL AS was, n.path IS NOT NULL AS now FROM o FULL JOIN n ON o.member = n.member AND o.path = n.path),
g AS (SELECT member, path, oo AS oid, om AS mode, count(*) OVER (PARTITION BY member, oo) AS c FROM j WHERE NOT now),
c AS (SELECT member, path, no AS oid, nm AS mode, count(*) OVER (PARTITION BY member, no) AS c FROM j WHERE NOT was),
r AS (SELECT g.member, g.path AS op, c.path AS np FROM g JOIN c ON g.member = c.member AND g.oid = c.oid AND g.mode = c.mode AND g.c = 1 AND c.c = 1),
ch AS (SELECT member, 'modified' AS change, path AS op, path AS np FROM j WHERE was AND now AND (oo IS DISTINCT FROM no OR om IS DISTINCT FROM nm)
  UNION ALL SELECT member, 'renamed_exact_blob', op, np FROM r
  UNION ALL SELECT member, 'deleted', path, NULL FROM g WHERE (member, path) NOT IN (SELECT (member, op) FROM r)
  UNION ALL SELECT member, 'added', NULL, path FROM c WHERE (member, path) NOT IN (SELECT (member, np) FROM r))"""
_SCANS = f"""WITH {R.FILES},
o AS (SELECT concat_ws(':', member, path) AS path, revision, status, bytes FROM f WHERE id % 9 <> 0),
n AS (SELECT concat_ws(':', member, path) AS path, CASE WHEN id % 4 = 0 THEN substr(revision, 1, 20) ELSE revision END AS revision, CASE WHEN id % 6 = 0 THEN 'cancelled' ELSE status END AS status, bytes FROM f WHERE id % 10 <> 0),
j AS (SELECT coalesce(o.path, n.path) AS path, o.path IS NOT NULL AS was, n.path IS NOT NULL AS now, o.revision AS r1, n.revision AS r2, o.status AS s1, n.status AS s2, o.bytes AS b1, n.bytes AS b2 FROM o FULL JOIN n ON o.path = n.path)"""
_REQ = "r AS (SELECT user_id AS request_id, CASE event_type WHEN 'view' THEN 'server' WHEN 'click' THEN 'delivery' WHEN 'error' THEN 'malformed' ELSE 'other' END AS kind, value > 10 AS complete, CAST(floor(value) AS BIGINT) AS tokens FROM events)"
_AUDIT = (
    "WITH "
    + _REQ
    + ", a AS (SELECT request_id, sum((kind = 'server')::INT) AS served, sum((kind = 'delivery' AND complete)::INT) AS delivered, sum((kind = 'delivery')::INT) AS deliveries, coalesce(sum(tokens) FILTER (kind = 'delivery' AND complete), 0) AS tokens, sum((kind = 'malformed')::INT) AS lost FROM r GROUP BY request_id)"
)
_HITS = f"WITH {R.FILES}, h AS (SELECT member, id, row_number() OVER (PARTITION BY member ORDER BY id) AS rank FROM f WHERE member IS NOT NULL)"
_KEY = "lower(regexp_replace({0}, '^\\\\+', ''))"

SQL = {
    "tree_compare": _TREES + " SELECT member, change, count(*) AS n FROM ch GROUP BY ALL",
    "scope_changes": _TREES
    + " SELECT CASE WHEN change = 'renamed_exact_blob' AND a AND NOT b THEN 'scope_boundary_out' WHEN change = 'renamed_exact_blob' AND b AND NOT a THEN 'scope_boundary_in' ELSE change END AS change, count(*) AS n FROM (SELECT change, coalesce(starts_with(op, 'src/'), false) AS a, coalesce(starts_with(np, 'src/'), false) AS b FROM ch) WHERE a OR b GROUP BY 1",
    "change_feed": _SCANS
    + """ SELECT kind, count(*) AS n FROM (SELECT CASE WHEN NOT was THEN 'added' WHEN NOT now AND r1 IS NULL THEN 'ignored_or_excluded' WHEN NOT now THEN 'deleted' WHEN r1 <> r2 THEN 'modified'
WHEN r1 IS DISTINCT FROM r2 OR s1 IS DISTINCT FROM s2 OR b1 IS DISTINCT FROM b2 THEN 'coverage_changed' END AS kind FROM j) WHERE kind IS NOT NULL GROUP BY kind""",
    "session_end": _SCANS
    + """, g AS (SELECT r1 AS r, count(*) AS n, min(path) AS p FROM j WHERE NOT now AND r1 IS NOT NULL GROUP BY r1), c AS (SELECT r2 AS r, count(*) AS n, min(path) AS p FROM j WHERE NOT was AND r2 IS NOT NULL GROUP BY r2),
m AS (SELECT g.p AS op, c.p AS np FROM g JOIN c ON g.r = c.r AND g.n = 1 AND c.n = 1), k AS (SELECT CASE WHEN NOT was THEN 'addition_without_preimage' WHEN NOT now AND r1 IS NULL THEN 'ignored_or_excluded' WHEN NOT now THEN 'deleted' WHEN r1 <> r2 THEN 'modified'
WHEN r1 IS DISTINCT FROM r2 OR s1 IS DISTINCT FROM s2 THEN 'coverage_change' END AS kind FROM j WHERE path NOT IN (SELECT op FROM m) AND path NOT IN (SELECT np FROM m) UNION ALL SELECT 'renamed' FROM m)
SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind""",
    "change_retention": "WITH t AS (SELECT strftime(observed_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS generation, count(*) AS rows FROM commits GROUP BY 1), r AS (SELECT *, count(*) OVER w AS n, sum(rows) OVER w AS reach FROM t WINDOW w AS (ORDER BY generation DESC ROWS UNBOUNDED PRECEDING)) SELECT generation, rows FROM r WHERE n <= 256 AND reach <= 4096",
    "observations_since": "SELECT member, count(DISTINCT generation) = 2 AND bool_and(parse_failures IS NOT NULL) AS complete FROM coverage WHERE generation > 0 AND generation <= 2 GROUP BY member",
    "blame": """WITH l AS (SELECT file_id, kind, row_number() OVER (PARTITION BY file_id ORDER BY id) AS line FROM (SELECT DISTINCT file_id, id, kind FROM definitions)),
i AS (SELECT *, line - row_number() OVER (PARTITION BY file_id, kind ORDER BY line) AS island FROM l) SELECT file_id, kind, min(line) AS first_line, max(line) AS last_line FROM i GROUP BY file_id, kind, island""",
    "fingerprints": "WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), c AS (SELECT t, count(*) AS documents FROM l GROUP BY t) SELECT documents, count(*) AS lines FROM c GROUP BY documents",
    "vector_normalise": "WITH n AS (SELECT vec_id AS id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS m FROM embeddings) SELECT id, round(v[1] / m, 6) AS first, round(v[64] / m, 6) AS last FROM n WHERE len(v) = 64 AND m > 0",
    "vector_validate": """SELECT CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> 64 THEN 'length' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'non_finite'
WHEN abs(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 0.001 THEN 'norm' ELSE 'ok' END AS state, count(*) AS n FROM vector_cache GROUP BY 1""",
    "vector_cache_put": "SELECT key, max(touched) AS touched FROM vector_cache GROUP BY key ORDER BY touched DESC, key LIMIT 500",
    "prepare_missing": "SELECT DISTINCT key FROM vector_cache WHERE key NOT IN (SELECT key FROM vector_cache WHERE touched % 2 = 0)",
    "fair_schedule": """WITH r AS (SELECT event_id AS arrived, user_id AS root, event_type = 'error' AS bg, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS nth FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY bg ORDER BY nth, root) AS place FROM r) SELECT arrived, CASE WHEN bg THEN place * 4 ELSE place + (place - 1) // 3 END AS slot FROM p""",
    "debounce": """WITH e AS (SELECT user_id, ts, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL), n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM n), t AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id, burst)) // 7200000000 AS tick FROM b)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM t GROUP BY user_id, burst, tick""",
    "ttl_expiry": "SELECT user_id FROM events GROUP BY user_id HAVING epoch_us(max(ts)) + 86400000000 > (SELECT epoch_us(max(ts)) FROM events)",
    "bounded_queue": "SELECT hour, least(n, 32) AS taken, greatest(n - 32, 0) AS dropped FROM (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1)",
    "audit": _AUDIT + " SELECT * FROM a",
    "audit_totals": _AUDIT + " SELECT count(*) AS requests, sum((delivered > 0)::INT) AS complete, sum(tokens) AS tokens, sum(lost) AS lost, sum(lost) = 0 AND sum((delivered > 0)::INT) = count(*) AS complete_window FROM a",
    "ledger": """WITH c AS (SELECT DISTINCT file_id AS session, id, revision, span_start AS s, span_end AS e FROM definitions), h AS (SELECT c.session, c.id, max(CASE WHEN r.region_id IS NULL THEN NULL WHEN r.definition IS NOT NULL THEN 1 ELSE 0 END) AS s
FROM c LEFT JOIN region_spans r ON r.file_id = c.session AND r.revision = c.revision AND c.s < r.span_end AND c.e > r.span_start GROUP BY 1, 2)
SELECT session, count(*) AS changes, coalesce(sum((s = 1)::INT), 0) AS source, coalesce(sum((s = 0)::INT), 0) AS metadata, sum((s IS NULL)::INT) AS unseen FROM h GROUP BY session""",
    "lane_trace": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT user_id AS request_id, event_type AS lane, count(*) AS hits, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 16) AS first FROM r GROUP BY 1, 2",
    "journal_segments": "WITH r AS (SELECT length(props) AS size, sum(length(props)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reach FROM events), s AS (SELECT CAST((reach - size) // 5000 AS BIGINT) AS segment, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1) SELECT segment, bytes, sum(bytes) OVER (ORDER BY segment DESC ROWS UNBOUNDED PRECEDING) <= 40000 AS kept FROM s",
    "agent_session_summary": """WITH e AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'show' WHEN 'signup' THEN 'ctx' ELSE 'refs' END AS verb, CAST(json_extract_string(props, '$.k') AS INT) AS k, value, event_type = 'error' AS err FROM events),
w AS (SELECT *, max((verb IN ('show', 'ctx', 'more'))::INT) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nx, lag(verb) OVER (PARTITION BY session ORDER BY seq) = verb AND lag(k) OVER (PARTITION BY session ORDER BY seq) IS NOT DISTINCT FROM k AS rep FROM e)
SELECT session, count(*) AS calls, sum((verb = 'search')::INT) AS searches, sum(err::INT) AS errors, sum((verb = 'search' AND k % 10 = 0)::INT) AS empties, coalesce(sum(rep::INT), 0) AS repeats, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, sum((verb = 'search' AND coalesce(nx, 0) = 1)::INT) AS followed FROM w GROUP BY session""",
    "agent_adoption": "SELECT user_id % 10 AS harness, sum((event_type IN ('view', 'click'))::INT) AS used, sum((event_type = 'error')::INT) AS escaped, round(sum((event_type IN ('view', 'click'))::INT) / sum((event_type IN ('view', 'click', 'error'))::INT), 6) AS adoption FROM events GROUP BY 1",
    "ws_merge": _HITS + " SELECT member, id, row_number() OVER (ORDER BY rank, member <> 'harbor-core', member) AS place FROM h WHERE rank <= 1000",
    "ws_widen": _HITS + " SELECT member, count(*) AS hits FROM h GROUP BY member",
    "ws_scope": _HITS + " SELECT member, count(*) AS files FROM f WHERE member IN (SELECT member FROM coverage) GROUP BY member",
    "ws_coverage": _HITS
    + """, c AS (SELECT member, count(*) AS n FROM h GROUP BY member), l AS (SELECT member, arg_max(excluded_files + walk_failures + truncated_files, (generation, captured_at)) AS p FROM coverage WHERE member IS NOT NULL GROUP BY member)
SELECT l.member, CASE WHEN coalesce(n, 0) > 0 THEN 'answered' ELSE 'empty' END AS state, least(coalesce(n, 0), 50) AS retained, coalesce(n, 0) > 50 AS truncated, p > 0 AS partial FROM l LEFT JOIN c ON c.member = l.member""",
    "ws_parent_fallback": _SCANS
    + " SELECT CASE WHEN n.revision IS NULL THEN 'absent' WHEN n.revision = f.revision THEN 'verified' ELSE 'differs' END AS state, count(*) AS n FROM f LEFT JOIN n ON n.path = concat_ws(':', f.member, f.path) GROUP BY 1",
    "ordered_chain": """WITH r AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS base, s_name AS i, floor(s_acctbal / 1000) AS p FROM supplier), s AS (SELECT base FROM r GROUP BY base HAVING count(DISTINCT i) + 1 <= 64),
g AS (SELECT *, dense_rank() OVER (PARTITION BY base ORDER BY p) AS g FROM r WHERE base IN (SELECT base FROM s))
SELECT a.base, a.i AS source, b.i AS target, CASE WHEN a.g = b.g THEN 'tie' ELSE 'previous' END AS kind FROM g a JOIN g b ON a.base = b.base AND ((a.g = b.g AND a.i <> b.i) OR b.g = a.g - 1) UNION ALL SELECT base, i, base, 'base' FROM g WHERE g = 1""",
    "chain_prepare": """SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS base, CASE WHEN s_acctbal <= -900 THEN 'unknown_order' WHEN floor(s_acctbal) < 0 THEN 'negative_order' END AS issue FROM supplier WHERE s_acctbal <= -900 OR floor(s_acctbal) < 0""",
    "correspond": """WITH o AS (SELECT DISTINCT id, file_id AS file, concat_ws('/', kind, name) AS key, CAST(span_end AS VARCHAR) AS digest FROM definitions),
n AS (SELECT id, file, CASE WHEN id % 5 = 0 THEN key || '2' ELSE key END AS key, CASE WHEN id % 3 = 0 THEN digest || '+' ELSE digest END AS digest FROM o WHERE id % 8 <> 0),
a AS (SELECT file, x.i AS oi, y.i AS ni FROM (SELECT file, key, digest, min(id) AS i FROM o GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT file, key, digest, min(id) AS i FROM n GROUP BY ALL HAVING count(*) = 1) y USING (file, key, digest)),
o2 AS (SELECT * FROM o WHERE (file, id) NOT IN (SELECT (file, oi) FROM a)), n2 AS (SELECT * FROM n WHERE (file, id) NOT IN (SELECT (file, ni) FROM a)),
b AS (SELECT file, x.i AS oi, y.i AS ni FROM (SELECT file, key, min(id) AS i FROM o2 GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT file, key, min(id) AS i FROM n2 GROUP BY ALL HAVING count(*) = 1) y USING (file, key)),
o3 AS (SELECT * FROM o2 WHERE (file, id) NOT IN (SELECT (file, oi) FROM b)), n3 AS (SELECT * FROM n2 WHERE (file, id) NOT IN (SELECT (file, ni) FROM b)),
c AS (SELECT file, x.i AS oi, y.i AS ni FROM (SELECT file, digest, min(id) AS i FROM o3 GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT file, digest, min(id) AS i FROM n3 GROUP BY ALL HAVING count(*) = 1) y USING (file, digest))
SELECT * FROM (SELECT 'unchanged' AS state, count(*) AS n FROM a UNION ALL SELECT 'modified', count(*) FROM b UNION ALL SELECT 'moved', count(*) FROM c UNION ALL SELECT 'deleted', count(*) FROM o3 WHERE (file, id) NOT IN (SELECT (file, oi) FROM c)
UNION ALL SELECT 'added', count(*) FROM n3 WHERE (file, id) NOT IN (SELECT (file, ni) FROM c)) WHERE n > 0""",
    "php_names": f"""WITH x AS (SELECT DISTINCT id, file_id, name, kind, span_start, span_end FROM definitions),
i AS (SELECT key, id FROM (SELECT DISTINCT {_KEY.format('name')} AS key, id FROM x WHERE kind IN ('class', 'interface', 'trait', 'enum') AND NOT starts_with(name, 'XFCP_')) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) <= 64),
c AS (SELECT DISTINCT s.id, y.id AS class FROM x s JOIN i ON i.key = {_KEY.format('s.name')} JOIN x y ON y.id = i.id WHERE s.kind = 'class' AND y.file_id <> s.file_id),
o AS (SELECT s.id, arg_min(y.id, (y.span_end - y.span_start, y.id)) AS owner FROM x s JOIN x y ON y.file_id = s.file_id AND y.span_start <= s.span_start AND s.span_end <= y.span_end WHERE s.kind = 'class' GROUP BY s.id)
SELECT id, string_agg(CAST(class AS VARCHAR), ',' ORDER BY class) AS candidates, any_value(owner) AS owner FROM c LEFT JOIN o USING (id) GROUP BY id""",
    "php_class_index": f"""WITH x AS (SELECT DISTINCT {_KEY.format('name')} AS key, id FROM definitions WHERE kind IN ('class', 'interface', 'trait', 'enum') AND NOT starts_with(regexp_replace(name, '^.*\\\\', ''), 'XFCP_'))
SELECT key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS classes FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) <= 64) GROUP BY key""",
    "alias_names": "SELECT DISTINCT name, 'Active\\' || name || 'Finder' AS canonical FROM definitions",
    "recall_at_k": f"""WITH {R.DEFS}, l AS (SELECT DISTINCT member AS task, file_id FROM defs WHERE kind = 'class'), h AS (SELECT member, id, row_number() OVER (PARTITION BY member ORDER BY id) AS rank FROM f WHERE member IS NOT NULL)
SELECT task, count(*) AS relevant, round(sum((coalesce(rank, 99) <= 5)::INT) / count(*), 6) AS recall_5, round(sum((coalesce(rank, 99) <= 10)::INT) / count(*), 6) AS recall_10, sum((coalesce(rank, 99) <= 10)::INT) = 0 AS miss FROM l LEFT JOIN h ON h.member = l.task AND h.id = l.file_id GROUP BY task""",
    "span_coverage": """WITH s AS (SELECT DISTINCT revision AS id, span_start AS a, span_end AS b FROM region_spans), c AS (SELECT revision AS id, octet_length(bytes) AS n FROM contents),
j AS (SELECT s.*, n, greatest(coalesce(max(b) OVER (PARTITION BY s.id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS reach FROM s JOIN c ON c.id = s.id WHERE b > 0 AND a < n),
g AS (SELECT id, max((a > reach)::INT) AS gap, max(b) AS reach FROM j GROUP BY id) SELECT c.id, coalesce(gap = 0 AND reach >= n, false) AS covered FROM c LEFT JOIN g ON g.id = c.id""",
    "grade_task": """WITH t AS (SELECT doc_id, lower(trim(source)) AS task, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT task, sum((doc_id % 3 <> 0)::INT) AS verified, sum((doc_id % 3 = 0)::INT) AS rejected FROM t GROUP BY task""",
    "usage_rollup": "SELECT member, CASE WHEN count(total_files) = count(*) THEN sum(total_files) END AS total_files, CASE WHEN count(parse_failures) = count(*) THEN sum(parse_failures) END AS parse_failures, count(total_files) < count(*) OR count(parse_failures) < count(*) AS censored FROM coverage GROUP BY member",
    "limits_exceeded": "SELECT member, generation, concat_ws(',', CASE WHEN indexed_bytes > 100000 THEN 'indexed_bytes' END, CASE WHEN total_files > 20 THEN 'total_files' END) AS exceeded FROM coverage",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_type, count(*) AS rows, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM r WHERE n > 12 GROUP BY event_type",
}
