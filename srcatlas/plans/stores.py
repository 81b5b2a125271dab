"""Sources, sinks, targets, budgets and federation: the inventory's operators that work on stores and requests, over the driver's tables."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, extraction, filters, history, journal, navigation, reads, resolution, targets, vectors
from ..operators import lanes as L
from ..session import shared_dir, table
from ..sources import generations as G
from ..sources import trees
from . import relations as R
from .retrieval import _filename


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of the current files, the second without every third file: what a reader then sees."""
    f = R.files(spark, d).select("id", "member", "path")
    store = G.Generations(spark, _folder(spark, "generations"))
    store.publish({"files": f}, "a")
    store.publish({"files": f.where("id % 3 <> 0")}, "b")
    return store.snapshot().table("files").groupBy("member").agg(F.count("*").alias("files"))


def open_read_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A reader stays with the generation it opened while another one is published; the same fingerprint publishes nothing."""
    f = R.files(spark, d).select("id", "member")
    store = G.Generations(spark, _folder(spark, "generations"))
    store.publish({"files": f}, "a")
    held = store.snapshot()
    store.publish({"files": f.where("id % 2 = 0")}, "b")
    again = store.publish({"files": f.limit(0)}, "b")
    old, new = (s.table("files").agg(F.count("*").alias("files")) for s in (held, store.snapshot()))
    return old.select(F.lit("held").alias("reader"), "files").unionByName(new.select(F.lit("opened_later").alias("reader"), "files")).withColumn("generations", F.lit(again))


def unpublished_view(spark: SparkSession, d: str) -> DataFrame:
    """Before the first publication a reader sees an empty table of the right columns."""
    return G.Generations(spark, _folder(spark, "generations")).snapshot().table("files", "id long, member string, path string")


def seed_cache(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.latest(table(spark, d, "vector_cache").select("key", F.size("vector").alias("dims"), "touched"))
    own, sibling = v.where("touched % 2 = 0"), v.withColumn("dims", F.lit(-1))
    return G.seed_cache(own, sibling, ["key"]).select("key", F.coalesce("dims", F.lit(-2)).alias("dims"))


def insert_facts(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of each file as local facts, each pointing to the one before it: the edges with global numbers."""
    x = table(spark, d, "definitions").select("file_id", "id", "name", "kind", "span_start", "span_end").groupBy("file_id", "id").agg(F.min(F.struct("name", "kind", "span_start", "span_end")).alias("s"))
    per = x.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", "s"))).alias("r"))
    facts = per.select(
        "file_id", F.transform("r", lambda x: F.struct(x["s"]["name"].alias("name"), x["s"]["kind"].alias("kind"), x["s"]["span_start"].alias("start"), x["s"]["span_end"].alias("end"))).alias("definitions"),
        F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.struct(i.alias("source"), F.when(i > 0, i - 1).alias("target"), F.lit("follows").alias("kind"))).alias("edges"),
    )
    _, e = corpus.insert_facts(facts)
    return e.where("target IS NOT NULL").select("file_id", "source", "target")


def ws_results(spark: SparkSession, d: str) -> DataFrame:
    """A page of a stored result set of files, by its cursor, with the cursor of the next one's offset."""
    f = L.filename(R.files(spark, d), ["ring"]).select("path", "rank")
    sets = G.ResultSets(spark, _folder(spark, "results"))
    part, nxt = G.page_of(sets, f"{sets.save(f)}@5", 10)
    return part.select("path", "rank", F.lit(int(nxt.split("@")[1]) if nxt else None).cast("int").alias("next"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Query texts made of definitions."""
    x = table(spark, d, "definitions").select("name", "kind").distinct()
    return x.select("name", "kind", F.concat(F.lit("lang:RS "), F.col("name"), F.lit("  word -file:gen/x kind:"), F.col("kind")).alias("text"))


def parse_query(spark: SparkSession, d: str) -> DataFrame:
    def parse(text: str) -> tuple:
        q = filters.parse_query(text)
        return q.text, q.language, q.kind, ",".join(q.excludes)

    f = F.udf(parse, "struct<words:string,language:string,kind:string,excludes:string>", useArrow=True)
    return _texts(spark, d).select("text", f("text").alias("q")).select("text", "q.*")


def concept_parse(spark: SparkSession, d: str) -> DataFrame:
    def parse(text: str) -> tuple:
        c = L.concept(text)
        return c["name"], c["qualifier"], " ".join(c["any"]), " ".join(c["phrase"])

    f = F.udf(parse, "struct<name:string,qualifier:string,any_terms:string,phrase:string>", useArrow=True)
    t = table(spark, d, "definitions").select(F.concat_ws("::", "container", "name").alias("text")).distinct()
    return t.select("text", f("text").alias("q")).select("text", "q.*")


def target_select(spark: SparkSession, d: str) -> DataFrame:
    """Targets ``sym:NAME`` of definitions' names: how many definitions each has to choose from."""
    x = table(spark, d, "definitions").select("id", "name").distinct().groupBy("name").agg(F.count("*").alias("n"))

    def choose(name: str, n: int) -> tuple:
        t = targets.select_target(f"sym:{name}", lambda _: [{"id": k} for k in range(n)])
        return t["kind"], len(t.get("candidates", []))

    f = F.udf(choose, "struct<kind:string,candidates:int>", useArrow=True)
    return x.select("name", f("name", "n").alias("t")).select("name", "t.*")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of every document: half its lines, all of them, and all with a line at the end."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    body = lambda lines: F.array_join(lines, "\n").cast("binary")
    rows = [(1, F.slice("l", 1, half)), (2, F.col("l")), (3, F.concat("l", F.array(F.lit("last line of all"))))]
    out = None
    for nth, lines in rows:
        v = t.where(F.size("l") > 1).select("path", F.lit(nth).alias("nth"), F.lit(f"c{nth}").alias("oid"), body(lines).alias("bytes"))
        out = v if out is None else out.unionByName(v)
    return out


def blame_lines(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines by the version they come from."""
    return history.blame_runs(history.blame(_versions(spark, d)), ["path"])


def symbol_history(spark: SparkSession, d: str) -> DataFrame:
    """States of all declarations of Rust bodies between each body and the same without its last third."""
    f = R.files(spark, d).where("revision IS NOT NULL AND path LIKE '%.rs'").groupBy("revision").agg(F.min("path").alias("path"))
    b = table(spark, d, "contents").join(f.hint("shuffle_hash"), "revision").select(F.col("revision").alias("file"), "path", "bytes")
    old = targets.declarations(b)
    new = targets.declarations(b.withColumn("bytes", F.expr("substring(bytes, 1, CAST(length(bytes) * 2 / 3 AS INT))")))
    return history.correspond(old, new).groupBy("state").agg(F.count("*").alias("n"))


def change_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents' lengths: those of even documents are in the cache, the rest is computed."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("before"), F.concat(F.col("doc_id").cast("string"), F.lit("x")).alias("after"))
    cache = t.where("CAST(before AS BIGINT) % 2 = 0").withColumn("origin", F.lit("cache"))
    every, fresh = targets.cached_compare(t, cache, lambda p: p.withColumn("origin", F.lit("computed")))
    return every.groupBy("origin").agg(F.count("*").alias("n"))


def cache_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Members as cache folders: those of the coverage's latest generation are live."""
    c = table(spark, d, "coverage").groupBy(F.col("member").alias("name")).agg(F.max("generation").alias("g"), F.max(F.unix_timestamp("captured_at")).cast("double").alias("touched"))
    kept, gone = corpus.sweep(c.select("name", "touched"), c.where("g > 1").select("name"), 4e9)
    return kept.select("name", F.lit("kept").alias("state")).unionByName(gone.select("name", F.lit("removed").alias("state")))


def staging_budget(spark: SparkSession, d: str) -> DataFrame:
    """The commits pass a budget that holds them, and fail one that doesn't."""
    c = table(spark, d, "commits").select("oid", F.length("oid").cast("long").alias("size"))
    rows = corpus.within_budget(c, 1 << 40, 1 << 50, "size").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    try:
        corpus.within_budget(c, 0, 0, "size")
        failed = False
    except RuntimeError:
        failed = True
    return rows.withColumn("smaller_budget_fails", F.lit(failed))


def derived_budget(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the class index's names and of the files, charged to one budget."""
    x = resolution.class_index(table(spark, d, "definitions"))
    spent = resolution.charged([x, R.files(spark, d)], 1 << 40)
    return spark.createDataFrame([(spent,)], "spent long")


def content_key(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of the documents' texts under two models."""
    f = F.udf(lambda t: [vectors.content_key(t, "m", model, 1, 64) for model in ("a", "b")], "array<string>", useArrow=True)
    t = table(spark, d, "documents").where("text IS NOT NULL").select("text").distinct()
    return t.select(F.explode(f("text")).alias("key")).agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"))


def admission(spark: SparkSession, d: str) -> DataFrame:
    """Events as batches of a few inputs, offered by user to a gate of four batches."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("nth"), (F.col("event_id") % 10 + 1).cast("int").alias("inputs"), F.lit(1).alias("size"))
    return vectors.admit(e, "user_id", 4, 8, 1 << 20)


def rerank_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Members' documents as a request for reranking: whether it is within the bounds."""

    def ok(n: int, longest: int) -> bool:
        try:
            vectors.check_rerank("q", ["x" * longest, *["x"] * (n - 1)])
        except ValueError:
            return False
        return True

    t = table(spark, d, "documents").groupBy("member", "source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    return t.select("member", "source", F.udf(ok, "boolean", useArrow=True)("n", F.least("longest", F.lit(5000))).alias("accepted"))


def delivery_receipt(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(lambda p, a, fl: tuple(journal.receipt(p, a, fl)[k] for k in ("complete", "failure")), "struct<complete:boolean,failure:string>", useArrow=True)
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("p"), (F.col("event_id") % 3).cast("int").alias("a"), (F.col("event_id") % 7 != 0).alias("f"))
    return e.where("a <= p").select("event_id", f("p", "a", "f").alias("r")).select("event_id", "r.*")


def retry_policy(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(lambda c: reads.retry(c), "struct<retries:int,delay:double>", useArrow=True)
    cause = F.when(F.col("event_type") == "error", "busy").when(F.col("event_type") == "click", "warming").when(F.col("event_type") == "view", "connection").otherwise("other")
    return table(spark, d, "events").select(cause.alias("cause")).distinct().select("cause", f("cause").alias("r")).select("cause", "r.*")


def page(spark: SparkSession, d: str) -> DataFrame:
    """Each member's file paths as hits: how many fit a page of 400 characters, and where the next one begins."""
    f = R.files(spark, d).where("member IS NOT NULL").groupBy("member").agg(F.slice(F.sort_array(F.collect_set("path")), 1, 50).alias("paths"))

    def fit(paths: list) -> tuple:
        p = reads.page([{"path": x} for x in paths], "s", 0, 50, 400, len)
        return len(p["hits"]), p["next"], len(json.dumps(p, ensure_ascii=False)) <= 400

    return f.select("member", F.udf(fit, "struct<shown:int,next:string,fits:boolean>", useArrow=True)("paths").alias("p")).select("member", "p.shown", "p.next", "p.fits")


def show_continue(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 50 lines of every UTF-8 body under 64 kB, followed by their offsets to the end: as many rows as lines."""

    def follow(revision: str, data: bytes) -> tuple:
        rows, pages, at = 0, 0, 0
        while at is not None:
            p = reads.show(data, revision, 0, len(data), at, 50)
            rows, pages, at = rows + len(p["rows"]), pages + 1, p["next"]
        return rows, pages

    t = table(spark, d, "contents").where("length(bytes) BETWEEN 1 AND 65536")
    return t.select("revision", F.udf(follow, "struct<lines:int,pages:int>", useArrow=True)("revision", "bytes").alias("p")).select("revision", "p.*")


def _facts(spark: SparkSession, d: str, facts: Collection[str] = extraction.FACTS, where: Column | None = None) -> DataFrame:
    """Facts of each body under its first path, of those that are as ``where`` says."""
    f = R.files(spark, d).where("revision IS NOT NULL")
    if where is not None:
        # before the first is taken: a body may stand under other paths too
        f = f.where(where)
    f = f.groupBy("revision").agg(F.min("path").alias("path"))
    return extraction.extract_all(table(spark, d, "contents").join(f.hint("shuffle_hash"), "revision"), facts)


def extract_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Files by extension and whether a family takes them."""
    x = _facts(spark, d).where("fact = 'file'")
    return x.groupBy(F.lower(F.substring_index("path", ".", -1)).alias("extension"), (F.col("status") != "lexical_only").alias("source")).agg(F.count("*").alias("files"))


def scope_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Names by role, and how many a scope of their file resolves or leaves open."""
    x = _facts(spark, d).where("fact = 'occurrence' AND kind <> 'declaration'")
    return x.groupBy("kind").agg(F.count("*").alias("uses"), F.count("target").alias("resolved"), F.count("candidates").alias("open"))


def php_markers(spark: SparkSession, d: str) -> DataFrame:
    """What extraction says of PHP classes and methods for the hierarchy."""
    php = F.lower(F.substring_index("path", ".", -1)).isin([e for e, f in extraction.FAMILY.items() if f == "php"])  # no other family fills these columns
    x = _facts(spark, d, ("definition",), php).where("(canonical IS NOT NULL OR visibility IS NOT NULL) AND kind <> 'import'")
    return x.groupBy("kind", "visibility", "abstract", "conditional", "complete").agg(F.count("*").alias("n"))


def parent_call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as classes under the supplier of half their number, customers as calls: the nearest supplier above whose method a call means."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    up = s.where("id > 1").select(F.col("id").alias("source"), F.floor(F.col("id") / 2).cast("long").alias("target"))
    m = s.where("id % 4 = 0").select("id", F.col("id").alias("class"), F.lit("run").alias("name"), F.when(F.col("id") % 3 == 0, "private").otherwise("public").alias("visibility"), (F.col("id") % 5 == 0).alias("abstract"))
    calls = s.select("id", F.col("id").alias("class"), F.lit("run").alias("name"))
    return resolution.parent_method(calls, up, m)


def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """A folder with one file a nation, under its region, and a hidden one: what a scan of it lists."""
    trees.register(spark)
    folder = _folder(spark, "tree")
    if not folder.startswith("file:"):
        folder = "file://" + folder
    root = folder[7:]
    for r in table(spark, d, "nation").select("n_name", "n_regionkey").collect():
        os.makedirs(f"{root}/r{r.n_regionkey}", exist_ok=True)
        with open(f"{root}/r{r.n_regionkey}/{r.n_name.replace(' ', '_')}.txt", "w") as f:
            f.write(r.n_name)
    with open(f"{root}/.gitignore", "w") as f:
        f.write("r3/\n")
    got = spark.read.format(trees.TreeSource.name()).option("path", root).load()
    return got.where("path NOT LIKE '%gitignore'").select("path", "status")


def read_contained(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of definitions' names: which a contained read refuses before it touches a disk."""

    def refused(path: str) -> bool:
        try:
            reads.read_contained("/nonexistent-root", path)
        except ValueError:
            return True
        except OSError:
            return False
        return False

    t = table(spark, d, "definitions").select("name").distinct()
    p = t.select(F.explode(F.array("name", F.concat(F.lit("../"), "name"), F.concat(F.lit("/"), "name"), F.concat(F.lit("a/../"), "name"))).alias("path"))
    return p.select("path", F.udf(refused, "boolean", useArrow=True)("path").alias("refused"))


def member_config(spark: SparkSession, d: str) -> DataFrame:
    """Configuration of the regions as members of a workspace."""
    names = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_name").collect()]
    text = '[workspace]\nname = "w"\n' + "".join(f'[members."{n}"]\npath = "/srv/{n}/"\n' for n in names)
    c = targets.member_config(text)
    return spark.createDataFrame([(n, c["members"][n]) for n in c["order"]], "member string, path string")


def rustdoc_query(spark: SparkSession, d: str) -> DataFrame:
    """Nations as documented items: those whose path matches a pattern."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    index = json.dumps({"paths": {str(r.n_nationkey): {"kind": "struct", "path": ["w", f"r{r.n_regionkey}", r.n_name]} for r in n}})
    return spark.createDataFrame([(x["id"], x["path"]) for x in targets.documented_items(index, r"^w::r[12]::.*A")], "id string, path string")


def show_stale_sym(spark: SparkSession, d: str) -> DataFrame:
    """Classes of Rust bodies looked up again, by name, in bytes that moved by a line: found where they are now."""
    # a body's structs are looked up together, so that its bytes are sent and extracted once for all of them
    x = _facts(spark, d, ("definition",), F.col("path").like("%.rs")).where("kind = 'struct'")
    x = x.groupBy("revision", "path").agg(F.collect_list(F.struct("name", "span_start")).alias("wanted"))
    body = table(spark, d, "contents").where("bytes IS NOT NULL").select("revision", "bytes")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[int] = Counter()
            for path, data, wanted in zip(*batch.columns):
                sites = [(w["name"], w["span_start"]) for w in wanted.as_py()]
                found = targets.reextract_all(path.as_py(), b"// moved\n" + data.as_py(), sites)
                n.update(y["start"] - near for y, (_, near) in zip(found, sites))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["moved_by", "n"])

    j = body.join(x.hint("shuffle_hash"), "revision").select("path", "bytes", "wanted")
    return j.mapInArrow(again, "moved_by int, n long").groupBy("moved_by").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        publish, open_read_snapshot, unpublished_view, seed_cache, insert_facts, ws_results, parse_query, concept_parse, target_select, blame_lines, symbol_history, change_cache, cache_sweep, staging_budget,
        derived_budget, content_key, admission, rerank_bounds, delivery_receipt, retry_policy, page, show_continue, extract_dispatch, scope_resolve, php_markers, parent_call_edges, scan_tree, read_contained,
        rustdoc_query, show_stale_sym,
    )
}
QUERIES["ws_config"] = member_config

_NATION_A = "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'w::r' || n_regionkey || '::' || n_name AS path FROM nation WHERE n_regionkey IN (1, 2) AND contains(n_name, 'A')"
SQL = {
    "publish": f"WITH {R.FILES} SELECT member, count(*) AS files FROM f WHERE id % 3 <> 0 GROUP BY member",
    "open_read_snapshot": f"WITH {R.FILES} SELECT 'held' AS reader, count(*) AS files, 2 AS generations FROM f UNION ALL SELECT 'opened_later', count(*), 2 FROM f WHERE id % 2 = 0",
    "seed_cache": """WITH v AS (SELECT key, arg_max(coalesce(len(vector), -1), touched) AS dims, max(touched) AS touched FROM vector_cache GROUP BY key)
SELECT key, CASE WHEN touched % 2 = 0 THEN CASE dims WHEN -1 THEN -2 ELSE dims END ELSE -1 END AS dims FROM v""",
    "insert_facts": """WITH x AS (SELECT DISTINCT file_id, id FROM definitions), n AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY id) - 1 AS k FROM x)
SELECT file_id, file_id * 100000 + k AS source, file_id * 100000 + k - 1 AS target FROM n WHERE k > 0""",
    "unpublished_view": "SELECT id, member, path FROM files WHERE false",
    "ws_results": f"WITH {R.FILES},\n{_filename('fi', ['ring'], 'f')} SELECT path, rank, 15 AS next FROM fi WHERE rank BETWEEN 6 AND 15",
    "parse_query": "SELECT DISTINCT 'lang:RS ' || name || '  word -file:gen/x kind:' || kind AS text, name || ' word' AS words, 'rust' AS language, kind, 'gen/x' AS excludes FROM definitions",
    "concept_parse": r"""WITH t AS (SELECT DISTINCT concat_ws('::', container, name) AS text FROM definitions),
p AS (SELECT text, string_split(text, '::') AS s, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS w FROM t),
c AS (SELECT *, len(list_filter(s, lambda x: NOT regexp_full_match(x, '\w+'))) = 0 AND regexp_matches(text, '[A-Za-z]') AND (len(s) > 1 OR regexp_matches(text, '_|[0-9]|[a-z][A-Z]')) AS code FROM p)
SELECT text, CASE WHEN code THEN s[-1] END AS name, CASE WHEN code AND len(s) > 1 THEN s[-2] END AS qualifier, array_to_string(list_filter(string_split(w, ' '), lambda x, i: list_position(string_split(w, ' '), x) = i), ' ') AS any_terms,
CASE WHEN len(regexp_extract_all(text, '\w+')) > 1 THEN w ELSE '' END AS phrase FROM c""",
    "target_select": "SELECT name, CASE WHEN count(*) = 1 THEN 'symbol' ELSE 'choose' END AS kind, CASE WHEN count(*) = 1 THEN 0 ELSE count(*) END AS candidates FROM (SELECT DISTINCT id, name FROM definitions) GROUP BY name",
    "change_cache": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'cache' ELSE 'computed' END AS origin, count(*) AS n FROM documents GROUP BY 1",
    "blame_lines": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, len(string_split(text, chr(10))) AS n FROM documents WHERE len(string_split(text, chr(10))) > 1), h AS (SELECT path, n, n // 2 AS h FROM t)
SELECT path, 'c1' AS oid, 1 AS first_line, h AS last_line FROM h UNION ALL SELECT path, 'c2', h + 1, n FROM h UNION ALL SELECT path, 'c3', n + 1, n + 1 FROM h""",
    "cache_sweep": "SELECT member AS name, CASE WHEN max(generation) > 1 THEN 'kept' ELSE 'removed' END AS state FROM coverage GROUP BY member",
    "staging_budget": "SELECT count(*) AS rows, sum(length(oid)) AS bytes, true AS smaller_budget_fails FROM commits",
    "derived_budget": f"WITH {R.FILES}, k AS (SELECT DISTINCT lower(ltrim(name, '\\')) AS key FROM definitions WHERE kind IN ('class', 'interface', 'trait', 'enum') AND NOT starts_with(regexp_replace(name, '^.*\\\\', ''), 'XFCP_')) SELECT (SELECT count(*) FROM k) + (SELECT count(*) FROM f) AS spent",
    "content_key": "SELECT 2 * count(DISTINCT text) AS rows, 2 * count(DISTINCT text) AS keys FROM documents",
    "admission": """WITH e AS (SELECT user_id, event_id % 10 + 1 AS n FROM events) SELECT user_id, least(4, count(*) FILTER (n <= 8)) AS admitted, count(*) - least(4, count(*) FILTER (n <= 8)) AS refused FROM e GROUP BY user_id""",
    "rerank_bounds": "SELECT member, source, count(*) <= 32 AND max(length(text)) <= 4096 AS accepted FROM documents GROUP BY member, source",
    "delivery_receipt": """WITH e AS (SELECT event_id, event_id % 5 AS p, event_id % 3 AS a, event_id % 7 <> 0 AS f FROM events) SELECT event_id, f AND a = p AS complete,
CASE WHEN f AND a = p THEN NULL WHEN a = p THEN 'flush' WHEN a = 0 THEN 'write_zero' ELSE 'write' END AS failure FROM e WHERE a <= p""",
    "retry_policy": """SELECT DISTINCT CASE event_type WHEN 'error' THEN 'busy' WHEN 'click' THEN 'warming' WHEN 'view' THEN 'connection' ELSE 'other' END AS cause,
CASE WHEN event_type IN ('error', 'click', 'view') THEN 1 ELSE 0 END AS retries, CASE event_type WHEN 'error' THEN 0.25 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.1 ELSE 0.0 END AS delay FROM events""",
    "show_continue": """WITH t AS (SELECT revision, (length(hex(bytes)) - length(replace(regexp_replace(hex(bytes), '(..)', '\\1 ', 'g'), '0A ', '')) * 2 // 3) // 2 + CASE WHEN ends_with(hex(bytes), '0A') THEN 0 ELSE 1 END AS lines
  FROM contents WHERE octet_length(bytes) BETWEEN 1 AND 65536) SELECT revision, lines, greatest(1, (lines + 49) // 50) AS pages FROM t""",
    "extract_dispatch": f"""WITH {R.FILES}, p AS (SELECT f.revision, min(path) AS path FROM f JOIN contents c ON c.revision = f.revision GROUP BY f.revision), x AS (SELECT lower(regexp_extract(path, '[^.]*$')) AS extension FROM p)
SELECT extension, extension IN ('rs', 'ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs', 'cs', 'php', 'phtml', 'lua', 'luau', 'dm') AS source, count(*) AS files FROM x GROUP BY 1, 2""",
    "parent_call_edges": """WITH RECURSIVE s AS (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier),
w AS (SELECT id AS call, id // 2 AS class, 1 AS hops FROM s WHERE id > 1 UNION ALL SELECT call, class // 2, hops + 1 FROM w WHERE class > 1 AND class % 4 <> 0)
SELECT call, class AS method, hops FROM w WHERE class % 4 = 0 AND class % 3 <> 0 AND class % 5 <> 0""",
    "scan_tree": "SELECT 'r' || n_regionkey || '/' || replace(n_name, ' ', '_') || '.txt' AS path, 'read' AS status FROM nation WHERE n_regionkey <> 3",
    "read_contained": "SELECT p || name AS path, p <> '' AS refused FROM (SELECT DISTINCT name FROM definitions), (SELECT unnest(['', '../', '/', 'a/../']) AS p)",
    "ws_config": "SELECT r_name AS member, '/srv/' || r_name AS path FROM region",
    "rustdoc_query": _NATION_A,
}
