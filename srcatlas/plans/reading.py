"""Reads, renderings, result sets, extraction by language, and what else is left of the inventory, over the driver's tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from ..operators import corpus, evaluate, extraction, history, journal, navigation, reads, resolution
from ..operators import lanes as L
from ..session import shared_dir, table
from ..sources import generations as G
from . import changes as C
from . import relations as R
from .retrieval import TERMS, _any, _filename


def project_compact(spark: SparkSession, d: str) -> DataFrame:
    x = R.definitions(spark, d)
    return x.select("id", "file_id", reads.compact(x).alias("hit")).distinct()


def sink_json_lines(spark: SparkSession, d: str) -> DataFrame:
    x = R.definitions(spark, d)
    return x.select(reads.lines_rendering(x, ["path", "name", "kind", "span_start"]).alias("line")).distinct()


def result_sink(spark: SparkSession, d: str) -> DataFrame:
    """Hours of events as result sets: those that fit a number and a size."""
    s = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("id")).agg(F.min("event_id").alias("created"), F.sum(F.length("props")).alias("bytes"))
    return reads.evict(s, 50, 5000).select("id", "bytes")


def result_load(spark: SparkSession, d: str) -> DataFrame:
    """First and last rank of the page of search hits from 20 to 40."""
    sets = G.ResultSets(spark, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}")
    sid = sets.save(L.any_terms(R.postings(spark, d), TERMS).select("path", "rank"))
    return sets.load(sid).where(F.col("rank").between(21, 40)).select("path", "rank")


def more(spark: SparkSession, d: str) -> DataFrame:
    """The page after a cursor of a stored set."""
    sets = G.ResultSets(spark, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}")
    sid = sets.save(L.filename(R.files(spark, d), ["ring"]).select("path", "rank"))
    return G.page_of(sets, f"{sid}@5", 10)[0].select("path", "rank")


def show_handle(spark: SparkSession, d: str) -> DataFrame:
    """First lines of every class."""
    x = R.definitions(spark, d).where("kind = 'class'").select("id", "revision", "span_start", "span_end").distinct()
    return reads.show_spans(table(spark, d, "contents").select("revision", "bytes"), x, 3)


def show_sym(spark: SparkSession, d: str) -> DataFrame:
    best = navigation.symbols(R.definitions(spark, d), "field2").where("rank <= 6").select("id", "revision", "span_start", "span_end")
    return reads.show_spans(table(spark, d, "contents").select("revision", "bytes"), best, 2)


def byte_escape(spark: SparkSession, d: str) -> DataFrame:
    """The lines that aren't UTF-8, with their bytes beyond ASCII escaped."""
    return reads.escaped_lines(table(spark, d, "contents"))


def no_definition(spark: SparkSession, d: str) -> DataFrame:
    """How many definitions of each name a filter by kind and path leaves, where it leaves none."""
    x = R.definitions(spark, d)
    hit = (F.col("kind") == "class") & F.col("path").startswith("src/")
    return navigation.no_definition(x, hit)


def container_scopes(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(lambda c: navigation.container_scopes(c), "array<array<string>>", useArrow=True)
    return table(spark, d, "definitions").select("container").distinct().select("container", F.to_json(f("container")).alias("scopes"))


def extract_cached(spark: SparkSession, d: str) -> DataFrame:
    """Facts in and missing from a cache that holds the bodies of even files, those of every sixth cancelled."""
    f = R.files(spark, d).where("revision IS NOT NULL").select("id", "revision", F.coalesce("language", F.lit("none")).alias("grammar"), F.lit(1).alias("version"))
    cache = f.where("id % 2 = 0").groupBy("revision", "grammar", "version").agg(F.when(F.min("id") % 6 == 0, "cancelled").otherwise("complete").alias("status"))
    hits, missed = corpus.cached_facts(f.select("revision", "grammar", "version").distinct(), cache)
    return hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("what"), "n").unionByName(missed.agg(F.count("*").alias("n")).select(F.lit("miss").alias("what"), "n"))


def _facts(spark: SparkSession, d: str, *ext: str, facts: Collection[str] = extraction.FACTS) -> DataFrame:
    f = R.files(spark, d).where("revision IS NOT NULL")
    f = f.where(F.lower(F.substring_index("path", ".", -1)).isin(*ext)).groupBy("revision").agg(F.min("path").alias("path"))
    return extraction.extract_all(table(spark, d, "contents").join(f.hint("shuffle_hash"), "revision"), facts)


def extract_csharp(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "cs")


def extract_php(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "php", "phtml")


def extract_dreammaker(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "dm")


def extract_modules(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, *extraction.FAMILY, facts=("module",)).select("revision", "path", "name", "span_start")


def resolve_modules(spark: SparkSession, d: str) -> DataFrame:
    """Each script imports the last script of its folder, by its name without extension."""
    f = R.files(spark, d)
    s = f.where(F.lower(F.substring_index("path", ".", -1)).isin("ts", "mts", "cts", "js", "mjs", "cjs")).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    last = s.groupBy("dir").agg(F.max("path").alias("last"))
    stem = F.regexp_replace(F.substring_index("last", "/", -1), r"\.[^.]*$", "")
    i = s.join(last, "dir").select("id", "path", F.concat(F.lit("./"), stem).alias("spelled"), F.lit("typescript").alias("language"))
    got = resolution.resolve_modules(i, f)
    return got.select("id", F.array_join("candidates", ",").alias("candidates"), "target")


def config_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nearest TOML file above each path, of any member."""
    f = R.files(spark, d).select("path").distinct()
    conf = f.where(F.col("path").endswith(".toml")).groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 1), "/").alias("directory")).agg(F.min("path").alias("config"))
    return resolution.nearest_config(f, conf)


def class_extensions(spark: SparkSession, d: str) -> DataFrame:
    """Extension files made of the nations, one of each region; region 3's is malformed."""
    n = table(spark, d, "nation")
    row = F.format_string('<extension from_class="%s" to_class="X_%s" active="%d" execute_order="%d"/>', "n_name", "n_name", F.col("n_nationkey") % 2, "n_nationkey")
    doc = n.groupBy("n_regionkey").agg(F.concat(F.lit("<x>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.when(F.col("n_regionkey") == 3, "<y>").otherwise(F.lit("</x>"))).alias("xml"))
    schema = "array<struct<from_class:string,to_class:string,active:boolean,execute_order:bigint>>"
    parse = F.udf(lambda x: [(r["from_class"], r["to_class"], r["active"], r["execute_order"]) for r in resolution.parse_extensions(x.encode())], schema, useArrow=True)
    return doc.select(F.explode(parse("xml")).alias("r")).select("r.*")


def addon_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Requirement keys of manifests made of the regions' nations."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"require": {'), F.array_join(F.transform(F.sort_array(F.collect_list("n_name")), lambda x: F.concat(F.lit('"'), x, F.lit('": 1'))), ", "), F.lit("}}")).alias("t"))
    parse = F.udf(lambda t: [(r["key"], r["start"], r["end"], r["repeated"]) for r in resolution.parse_requirements(t)], "array<struct<key:string,start:bigint,end:bigint,repeated:boolean>>", useArrow=True)
    return n.select(F.explode(parse("t")).alias("r")).select("r.key", "r.start", "r.end", "r.repeated")


def php_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "definitions").select("id", "name", "kind", "container").distinct()
    c = x.select("id", F.col("container").alias("parent"), (F.col("id") % 17 == 0).alias("conditional"), (F.col("id") % 19 != 0).alias("complete"))
    return resolution.parent_status(c, resolution.class_index(x)).select("id", "status")


def parent_method_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Methods of the nearest class above, along containers of a file's classes taken as parents in order of their ids."""
    x = table(spark, d, "definitions").select("id", "file_id", "name", "kind", "container").distinct()
    cls = x.where("kind = 'class'").select("id", "file_id", "name")
    a, b = cls.alias("a"), cls.alias("b")
    up = a.join(b, F.col("a.file_id") == F.col("b.file_id")).where("b.id < a.id").groupBy("a.id").agg(F.max("b.id").alias("target")).select(F.col("id").alias("source"), "target")
    m = x.where("kind = 'method'").join(cls.select(F.col("id").alias("class"), "file_id", F.col("name").alias("container")), ["file_id", "container"])
    m = m.select("id", "class", F.substring("name", 1, 3).alias("name"), F.when(F.col("id") % 5 == 0, "private").otherwise("public").alias("visibility"), (F.col("id") % 7 == 0).alias("abstract"))
    return resolution.parent_method(m.select("id", "class", "name"), up, m, 8)


def since(spark: SparkSession, d: str) -> DataFrame:
    return history.since(*C._trees(spark, d), by=["member"]).groupBy("change").agg(F.count("*").alias("n"))


def since_uncommitted(spark: SparkSession, d: str) -> DataFrame:
    return history.since_uncommitted(*C._scans(spark, d))


def diff(spark: SparkSession, d: str) -> DataFrame:
    """Lines gone by document between the texts of ``line_diff``."""
    return history.diff_sizes(C.line_pairs(spark, d))


def hist(spark: SparkSession, d: str) -> DataFrame:
    old, new = (t.where("member = 'harbor-core'").select("path", "oid", "mode") for t in C._trees(spark, d))
    first = new.join(old, ["path"], "left_anti").agg(F.min("path")).first()[0] or ""
    return spark.createDataFrame([(r["step"], r["change"]) for r in history.history_of(first, [new, old])], "step int, change string")


def session_start(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    s = journal.session_start(t.select(F.col("doc_id").alias("id"), "text"))
    return s.select(F.col("id").alias("doc_id"), F.size("lines").alias("lines"), F.element_at("lines", 1).alias("first"), F.element_at("lines", -1).alias("last"))


def emitted_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Places (path and line) that documents name."""
    return journal.emitted_evidence(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


def search_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Classes of shell searches made of definitions."""
    cmd = F.concat(F.when(F.col("kind") == "class", "rg 'class ").when(F.col("kind") == "method", "grep -w '").otherwise("rg -A3 '"), F.col("name"), F.lit("'"))
    f = F.udf(evaluate.classify_search, "string", useArrow=True)
    return table(spark, d, "definitions").select("kind", f(cmd).alias("class")).groupBy("kind", "class").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        project_compact, sink_json_lines, result_sink, result_load, more, show_handle, show_sym, byte_escape, no_definition, container_scopes, extract_cached, extract_csharp, extract_php,
        extract_dreammaker, extract_modules, resolve_modules, config_lookup, class_extensions, addon_manifest, php_hierarchy, parent_method_lookup, since, since_uncommitted, diff, hist,
        session_start, emitted_evidence, search_classifier,
    )
}

_STATUS = f"""WITH x AS (SELECT DISTINCT id, name, kind, container FROM definitions),
i AS (SELECT DISTINCT {C._KEY.format('name')} AS key, id FROM x WHERE kind IN ('class', 'interface', 'trait', 'enum') AND NOT starts_with(name, 'XFCP_')),
k AS (SELECT key, count(*) AS n, min(id) AS one FROM i GROUP BY key),
s AS (SELECT x.id, k.one, CASE WHEN regexp_matches(container, '[^A-Za-z0-9_\\\\]') THEN 'unsupported' WHEN x.id % 17 = 0 THEN 'conditional' WHEN x.id % 19 = 0 THEN 'incomplete' WHEN k.n IS NULL THEN 'missing' WHEN k.n > 1 THEN 'ambiguous' ELSE 'single' END AS status
  FROM x LEFT JOIN k ON k.key = {C._KEY.format('x.container')} WHERE container IS NOT NULL)"""


def _shown(spans: str, most: int) -> str:
    """Lines of spans (id, revision, a, b), at most so many of each."""
    return f"""WITH {spans}, j AS (SELECT s.id, try(decode(c.bytes[a + 1:b])) AS t, regexp_replace(hex(c.bytes[1:a]), '(..)', '\\1 ', 'g') AS p FROM s JOIN contents c USING (revision) WHERE a >= 0 AND b >= a AND b <= octet_length(c.bytes)),
n AS (SELECT id, string_split(CASE WHEN ends_with(t, chr(10)) THEN substr(t, 1, length(t) - 1) ELSE t END, chr(10))[1:{most}] AS l, 1 + (length(p) - length(replace(p, '0A ', ''))) // 3 AS first FROM j WHERE t IS NOT NULL)
SELECT id, line, text FROM (SELECT id, unnest(range(first, first + len(l))) AS line, unnest(l) AS text FROM n)"""


SQL = {
    "show_handle": _shown(f"{R.DEFS}, s AS (SELECT DISTINCT id, revision, span_start AS a, span_end AS b FROM defs WHERE kind = 'class')", 3),
    "show_sym": _shown(f"{R.DEFS}, s AS (SELECT id, revision, span_start AS a, span_end AS b FROM defs WHERE name = 'field2' QUALIFY row_number() OVER (ORDER BY CASE WHEN kind = 'module' THEN 1 WHEN kind IN ('variant', 'field', 'constructor') THEN 2 WHEN kind IN ('variable', 'parameter', 'import') THEN 3 ELSE 0 END, {R.IS_TEST.format('path')}, path, span_start, span_end, id) <= 6)", 2),
    "addon_manifest": """SELECT n_name AS key, CAST(14 + before AS BIGINT) AS start, CAST(14 + before + length(n_name) AS BIGINT) AS "end", false AS repeated
FROM (SELECT n_name, coalesce(sum(length(n_name) + 7) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nation)""",
    "search_classifier": "SELECT kind, CASE kind WHEN 'class' THEN 'definition' WHEN 'method' THEN 'reference' ELSE 'body' END AS class, count(*) AS n FROM definitions GROUP BY kind",
    "project_compact": f"""WITH {R.DEFS} SELECT DISTINCT id, file_id, CAST(to_json(struct_pack(path := path, kind := kind, name := CASE WHEN length(name) > 96 THEN substr(name, 1, 95) || '…' ELSE name END)) AS VARCHAR) AS hit FROM defs""",
    "sink_json_lines": f"WITH {R.DEFS} SELECT DISTINCT concat_ws(chr(9), path, name, kind, CAST(span_start AS VARCHAR)) AS line FROM defs",
    "result_sink": "WITH s AS (SELECT strftime(ts, '%Y-%m-%d %H') AS id, min(event_id) AS created, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1), r AS (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS reach FROM s WINDOW w AS (ORDER BY created DESC, id ROWS UNBOUNDED PRECEDING)) SELECT id, bytes FROM r WHERE n <= 50 AND reach <= 5000",
    "result_load": f"WITH {R.REGIONS},\n{_any('an', TERMS)} SELECT path, rank FROM an WHERE rank BETWEEN 21 AND 40",
    "more": f"WITH {R.FILES},\n{_filename('fi', ['ring'], 'f')} SELECT path, rank FROM fi WHERE rank BETWEEN 6 AND 15",
    "no_definition": f"WITH {R.DEFS} SELECT name, count(*) AS without_filters FROM defs GROUP BY name HAVING sum((kind = 'class' AND starts_with(path, 'src/'))::INT) = 0",
    "extract_cached": f"""WITH {R.FILES}, w AS (SELECT DISTINCT revision, coalesce(language, 'none') AS g FROM f WHERE revision IS NOT NULL), c AS (SELECT revision, coalesce(language, 'none') AS g, min(id) AS m FROM f WHERE revision IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2),
h AS (SELECT count(*) AS n FROM w JOIN c USING (revision, g) WHERE m % 6 <> 0) SELECT 'hit' AS what, n FROM h UNION ALL SELECT 'miss', (SELECT count(*) FROM w) - n FROM h""",
    "resolve_modules": f"""WITH {R.FILES}, s AS (SELECT id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE lower(regexp_extract(path, '[^.]*$')) IN ('ts', 'mts', 'cts', 'js', 'mjs', 'cjs')),
l AS (SELECT dir, regexp_replace(max(path), '\\.[^./]*$', '') AS stem FROM s GROUP BY dir), v AS (SELECT unnest(['', '.ts', '.tsx', '.mts', '.cts', '.d.ts', '.js', '.mjs', '.cjs', '/index.ts', '/index.js']) AS v),
h AS (SELECT DISTINCT s.id, p.path AS c FROM s JOIN l USING (dir) CROSS JOIN v JOIN (SELECT DISTINCT path FROM f) p ON p.path = l.stem || v.v)
SELECT id, string_agg(c, ',' ORDER BY c) AS candidates, CASE WHEN count(*) = 1 THEN min(c) END AS target FROM h GROUP BY id""",
    "parent_method_lookup": """WITH RECURSIVE x AS (SELECT DISTINCT id, file_id, name, kind, container FROM definitions), cls AS (SELECT id, file_id, name FROM x WHERE kind = 'class'),
up AS (SELECT a.id AS source, max(b.id) AS target FROM cls a JOIN cls b ON a.file_id = b.file_id AND b.id < a.id GROUP BY a.id),
m AS (SELECT x.id, c.id AS class, substr(x.name, 1, 3) AS name, x.id % 5 <> 0 AND x.id % 7 <> 0 AS good FROM x JOIN cls c ON c.file_id = x.file_id AND c.name = x.container WHERE x.kind = 'method'),
w AS (SELECT m.id AS call, up.target AS class, m.name, 1 AS hops FROM m JOIN up ON up.source = m.class
  UNION ALL SELECT w.call, up.target, w.name, w.hops + 1 FROM w JOIN up ON up.source = w.class WHERE w.hops < 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.class = w.class AND m.name = w.name))
SELECT w.call, m.id AS method, w.hops FROM w JOIN m ON m.class = w.class AND m.name = w.name WHERE m.good""",
    "byte_escape": """WITH b AS (SELECT revision, string_split(regexp_replace(hex(bytes), '(..)', '\\1 ', 'g'), '0A ') AS l FROM contents WHERE try(decode(bytes)) IS NULL AND bytes IS NOT NULL),
r AS (SELECT revision, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS h FROM b), e AS (SELECT * FROM r WHERE try(decode(unhex(replace(h, ' ', '')))) IS NULL)
SELECT revision, line, array_to_string(list_transform(string_split(trim(h), ' '), lambda x: CASE WHEN (x >= '20' AND x < '7F') OR x = '09' THEN decode(unhex(x)) ELSE '\\x' || lower(x) END), '') AS text FROM e""",
    "config_lookup": f"WITH {R.FILES}, p AS (SELECT DISTINCT path FROM f), c AS (SELECT split_part(path, '/', 1) AS directory, min(path) AS config FROM p WHERE path LIKE '%.toml' GROUP BY 1) SELECT path, config FROM p JOIN c ON starts_with(path, directory || '/')",
    "class_extensions": "SELECT n_name AS from_class, 'X_' || n_name AS to_class, n_nationkey % 2 = 1 AS active, CAST(n_nationkey AS BIGINT) AS execute_order FROM nation WHERE n_regionkey <> 3",
    "php_hierarchy": _STATUS + " SELECT id, status FROM s",
    "php_extends_edges": _STATUS + " SELECT CASE WHEN status <> 'single' THEN status WHEN one = id THEN 'self' ELSE 'edge' END AS what, count(*) AS n FROM s GROUP BY 1",
    "since": C._TREES + " SELECT change, count(*) AS n FROM ch GROUP BY change",
    "since_uncommitted": C._SCANS
    + """ SELECT path, kind FROM (SELECT path, CASE WHEN NOT was THEN 'added' WHEN NOT now AND r1 IS NULL THEN 'ignored_or_excluded' WHEN NOT now THEN 'deleted' WHEN r1 <> r2 THEN 'modified'
WHEN r1 IS DISTINCT FROM r2 OR s1 IS DISTINCT FROM s2 OR b1 IS DISTINCT FROM b2 THEN 'coverage_changed' END AS kind FROM j) WHERE kind IS NOT NULL""",
    "diff": "SELECT doc_id AS id, len(string_split(text, chr(10))) // 7 AS removed, 0 AS added FROM documents WHERE len(string_split(text, chr(10))) >= 7",
    "session_start": "SELECT doc_id, len(l) AS lines, substr(sha256(l[1]), 1, 16) AS first, substr(sha256(l[-1]), 1, 16) AS last FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "emitted_evidence": r"SELECT DISTINCT doc_id, split_part(p, ':', 1) AS path, CAST(split_part(p, ':', 2) AS BIGINT) AS line FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+(?:/[A-Za-z_]+)+\.[a-z]+:[0-9]+')) AS p FROM documents)",
}
