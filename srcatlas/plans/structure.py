"""Symbols, references, outlines, walks and resolution over definitions; corpus queries over files and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as FP
from ..operators import corpus, vectors
from ..operators import navigation as N
from ..session import table
from . import relations as R


def sym_exact(spark: SparkSession, d: str) -> DataFrame:
    return N.symbols(R.definitions(spark, d), "field2", "src/ring").select("id", "file_id", "rank")


def rank_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Rank keys of every definition."""
    x = R.definitions(spark, d)
    return x.select("id", "file_id", "span_start", N.kind_tier(F.col("kind")).alias("tier"), FP.is_test_path(F.col("path")).alias("test"), N.shared_depth(F.col("path"), "src/ring").alias("depth")).distinct()


def qualified_match(spark: SparkSession, d: str) -> DataFrame:
    return N.qualified(R.definitions(spark, d), ["Safe"], None).select("id", "file_id", "span_start", "tier").distinct()


def owner_hint(spark: SparkSession, d: str) -> DataFrame:
    x = R.definitions(spark, d)
    return x.where(N.owner_hint(["ring"])).groupBy("kind").agg(F.count("*").alias("n"))


def module_segments(spark: SparkSession, d: str) -> DataFrame:
    return R.files(spark, d).select("id", F.array_join(FP.module_segments(F.col("path")), "/").alias("segments"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    o = R.definitions(spark, d).withColumn("role", F.when(F.col("kind") == "constant", "declaration").when(F.col("kind") == "class", "import").otherwise("call"))
    return N.references(o).select("id", "file_id", "span_start", "tier").distinct()


def _sites(spark: SparkSession, d: str) -> DataFrame:
    # a definition's place in hundreds of bytes stands for its line
    x = R.definitions(spark, d)
    return x.select("id", "name", "path", F.floor(F.col("span_start") / 100).cast("long").alias("line"), F.col("kind").alias("role"), F.lit(None).cast("long").alias("target"))


def refs_collapse(spark: SparkSession, d: str) -> DataFrame:
    return N.collapse_references(_sites(spark, d)).select("name", "path", "line", "role", "repeats", "id")


def refs_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.reference_summary(_sites(spark, d))


def map_file(spark: SparkSession, d: str) -> DataFrame:
    return N.outline(table(spark, d, "definitions").select("file_id", "id", "name", "kind", "span_start").distinct())


def map_directory(spark: SparkSession, d: str) -> DataFrame:
    return N.directory_outline(table(spark, d, "definitions").select("file_id", "id", "name", "kind", "span_start", "container").distinct())


def map_miss(spark: SparkSession, d: str) -> DataFrame:
    return N.map_miss(R.files(spark, d), "core/ring/relay.rs")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Containment as edges: a definition points to those of its file whose name is its container."""
    x = table(spark, d, "definitions").select("id", "file_id", "name", "container", "span_start", "span_end", "kind").distinct()
    owner = x.where("container IS NULL").select(F.col("id").alias("target"), "file_id", F.col("name").alias("container"))
    return x, x.select(F.col("id").alias("source"), "file_id", "container", "kind").join(owner, ["file_id", "container"]).select("source", "target", "kind").distinct()


def ctx(spark: SparkSession, d: str) -> DataFrame:
    x, e = _graph(spark, d)
    return N.context(x.where("kind = 'method'"), x, e)


def definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    x, e = _graph(spark, d)
    return N.definition_lookup(e, x)


def inheritance_walk(spark: SparkSession, d: str) -> DataFrame:
    x, e = _graph(spark, d)
    return N.walk(x.where("kind = 'method'").select("id"), e).groupBy("hops").agg(F.count("*").alias("nodes"))


def follow_import(spark: SparkSession, d: str) -> DataFrame:
    x, e = _graph(spark, d)
    return N.follow_imports(x.where("kind = 'method'").select("id").distinct(), e.select(F.col("source").alias("id"), "target")).groupBy("hop").agg(F.count("*").alias("trails"))


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    x = R.definitions(spark, d).withColumn("language", FP.language_column(F.col("language"))).where("language IS NOT NULL")
    o = x.where("kind = 'method'").select("id", "name", "language", F.lit(None).cast("long").alias("target")).distinct()
    t = x.where("kind <> 'method'").select("id", "name", "language").distinct()
    return N.resolve_names(o, t).select("id", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return corpus.content_dedup(t.select(F.col("text").cast("binary").alias("bytes"))).select("revision", "copies")


def fingerprint_skip(spark: SparkSession, d: str) -> DataFrame:
    """Per member whether its scan differs from the one before: digests of the rows of each generation."""
    t = table(spark, d, "files").select("member", "generation", "path", "status", "bytes", "revision").distinct()
    g = corpus.scan_fingerprint(t, ["member", "generation"])
    return g.groupBy("member").agg(F.countDistinct("fingerprint").alias("scans"), F.sum("files").alias("files"))


def read_source(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion ladder over bodies and their reported sizes."""
    files = R.files(spark, d).select("id", "path", "revision", F.col("bytes").alias("length"))
    return corpus.read_status(files.join(table(spark, d, "contents"), "revision", "left")).groupBy("status").agg(F.count("*").alias("files"))


def region_partition(spark: SparkSession, d: str) -> DataFrame:
    return corpus.region_partition(table(spark, d, "contents"), table(spark, d, "definitions"))


def region_faults(spark: SparkSession, d: str) -> DataFrame:
    return corpus.region_faults(table(spark, d, "region_spans"), table(spark, d, "contents"))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    """Orphans both ways between relations, as counts."""
    return corpus.doctor(*(table(spark, d, n) for n in ("files", "contents", "definitions", "region_spans")))


def vector_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Latest vector per key: length and provenance only."""
    t = table(spark, d, "vector_cache").select("key", "touched", F.size("vector").alias("dims"))
    return vectors.lookup(vectors.latest(t), t.select("key")).select("key", "dims", "touched")


QUERIES = {
    f.__name__: f
    for f in (
        sym_exact, rank_declarations, qualified_match, owner_hint, module_segments, refs, refs_collapse, refs_summary, map_file, map_directory, map_miss, ctx, definition_lookup,
        inheritance_walk, follow_import, resolve_names, content_dedup, fingerprint_skip, read_source, region_partition, region_faults, doctor, vector_cache_lookup,
    )
}

_GRAPH = """x AS (SELECT DISTINCT id, file_id, name, container, span_start, span_end, kind FROM definitions),
e AS (SELECT DISTINCT a.id AS source, b.id AS target, a.kind FROM x a JOIN x b ON a.file_id = b.file_id AND a.container = b.name AND b.container IS NULL)"""
_DEPTH = "CASE WHEN split_part({0}, '/', 1) = 'src' AND len(string_split({0}, '/')) > 1 THEN 1 + CASE WHEN split_part({0}, '/', 2) = 'ring' AND len(string_split({0}, '/')) > 2 THEN 1 ELSE 0 END ELSE 0 END".format("path")
_TIERS = "CASE WHEN kind = 'module' THEN 1 WHEN kind IN ('variant', 'field', 'constructor') THEN 2 WHEN kind IN ('variable', 'parameter', 'import') THEN 3 ELSE 0 END"
_T = R.IS_TEST.format("path")
_LANGC = "CASE WHEN lower(trim(language)) IN ('rust','rs') THEN 'rust' WHEN lower(trim(language)) IN ('typescript','ts','tsx','javascript','js','jsx') THEN 'script' WHEN lower(trim(language)) IN ('csharp','c#','cs') THEN 'csharp' WHEN lower(trim(language)) = 'php' THEN 'php' WHEN lower(trim(language)) IN ('luau','lua') THEN 'luau' WHEN lower(trim(language)) IN ('dreammaker','dm','byond') THEN 'dreammaker' WHEN lower(trim(language)) IN ('text','txt') THEN 'text' END"
_SITES = f"{R.DEFS}, s AS (SELECT id, name, path, CAST(floor(span_start / 100) AS BIGINT) AS line, kind AS role FROM defs)"
_SEG = R.SEGMENTS

SQL = {
    "sym_exact": f"WITH {R.DEFS} SELECT id, file_id, row_number() OVER (ORDER BY {_TIERS}, {_T}::INT, -({_DEPTH}), path, span_start, span_end, id) AS rank FROM defs WHERE name = 'field2'",
    "rank_declarations": f"WITH {R.DEFS} SELECT DISTINCT id, file_id, span_start, {_TIERS} AS tier, {_T} AS test, {_DEPTH} AS depth FROM defs",
    "qualified_match": f"""WITH {R.DEFS}, o AS (SELECT *, list_concat(string_split({_SEG}, '/'), CASE WHEN container IS NULL THEN [] ELSE regexp_split_to_array(container, '::|[\\\\./]') END) AS owner FROM defs),
t AS (SELECT id, file_id, span_start, CASE WHEN owner[-1] = 'Safe' THEN 0 WHEN list_contains(owner, 'Safe') THEN 1 END AS tier FROM o)
SELECT DISTINCT id, file_id, span_start, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "owner_hint": f"WITH {R.DEFS} SELECT kind, count(*) AS n FROM defs WHERE contains(coalesce(container, '') || '/' || replace(path, '-', '_'), 'ring') GROUP BY kind",
    "module_segments": f"WITH {R.FILES} SELECT id, {_SEG} AS segments FROM f",
    "refs": f"WITH {R.DEFS} SELECT DISTINCT id, file_id, span_start, CASE WHEN {_T} THEN 3 WHEN kind = 'constant' THEN 0 WHEN kind = 'class' THEN 2 ELSE 1 END AS tier FROM defs",
    "refs_collapse": f"WITH {_SITES} SELECT name, path, line, role, count(*) AS repeats, min(id) AS id FROM s GROUP BY name, path, line, role",
    "refs_summary": f"WITH {_SITES} SELECT name, count(*) AS sites, count(DISTINCT path) AS files, count(*) > 10000 AS truncated FROM s GROUP BY name",
    "map_file": """WITH x AS (SELECT DISTINCT file_id, id, name, kind, span_start, (kind IN ('field','variant','variable','parameter','import','constant'))::INT AS folded FROM definitions WHERE kind <> 'module')
SELECT file_id, id, name, kind, folded, row_number() OVER (PARTITION BY file_id ORDER BY folded, span_start, id) AS place FROM x""",
    "map_directory": """WITH x AS (SELECT DISTINCT file_id, id, name, kind, span_start, container FROM definitions WHERE container IS NULL AND kind <> 'module'),
g AS (SELECT *, CASE WHEN kind IN ('class','struct','interface','trait','enum','record') THEN 0 WHEN kind IN ('function','macro') THEN 1 ELSE 2 END AS g FROM x),
r AS (SELECT *, row_number() OVER w AS n, sum(length(name) + 2) OVER (PARTITION BY file_id ORDER BY g, span_start, id ROWS UNBOUNDED PRECEDING) - 2 AS reach FROM g WINDOW w AS (PARTITION BY file_id ORDER BY g, span_start, id))
SELECT file_id, coalesce(string_agg(name, ', ' ORDER BY n) FILTER (reach <= 90), '') || CASE WHEN sum((reach > 90)::INT) > 0 THEN ' +' || CAST(sum((reach > 90)::INT) AS VARCHAR) ELSE '' END AS names FROM r GROUP BY file_id""",
    "map_miss": f"""WITH {R.FILES}, p AS (SELECT DISTINCT path, list_reverse(string_split(path, '/')) AS q FROM f)
SELECT path, CASE WHEN q[1] = 'relay.rs' THEN 1 + CASE WHEN q[2] = 'ring' THEN 1 + CASE WHEN q[3] = 'core' THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END AS shared, levenshtein(q[1], 'relay.rs') AS distance FROM p ORDER BY shared DESC, distance, path LIMIT 3""",
    "ctx": f"""WITH {_GRAPH},
h AS (SELECT DISTINCT h.id AS hit_id, n.id AS node FROM x h JOIN x n ON n.file_id = h.file_id AND n.span_start <= h.span_start AND h.span_end <= n.span_end WHERE h.kind = 'method'),
u AS (SELECT hit_id, source, target, kind FROM h JOIN e ON e.source = h.node UNION SELECT hit_id, source, target, kind FROM h JOIN e ON e.target = h.node)
SELECT hit_id, source, target, kind FROM u QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY kind, source, target) <= 100""",
    "definition_lookup": f"WITH {_GRAPH} SELECT e.source, e.target, y.file_id, y.name FROM e JOIN (SELECT DISTINCT id, file_id, name FROM x) y ON y.id = e.target",
    "inheritance_walk": f"""WITH {_GRAPH}, s AS (SELECT DISTINCT id FROM x WHERE kind = 'method'), t AS (SELECT DISTINCT target AS id FROM e JOIN s ON s.id = e.source WHERE target NOT IN (SELECT id FROM s)),
u AS (SELECT DISTINCT target AS id FROM e JOIN t ON t.id = e.source WHERE target NOT IN (SELECT id FROM s) AND target NOT IN (SELECT id FROM t))
SELECT * FROM (SELECT 0 AS hops, count(*) AS nodes FROM s UNION ALL SELECT 1, count(*) FROM t UNION ALL SELECT 2, count(*) FROM u) WHERE nodes > 0""",
    "follow_import": f"""WITH {_GRAPH}, s AS (SELECT DISTINCT id FROM x WHERE kind = 'method'), d AS (SELECT source, target FROM e),
a AS (SELECT s.id AS start, d.target AS id FROM s JOIN d ON d.source = s.id WHERE d.target <> s.id), b AS (SELECT a.start, d.target AS id FROM a JOIN d ON d.source = a.id WHERE d.target <> a.start AND d.target <> a.id)
SELECT * FROM (SELECT 0 AS hop, count(*) AS trails FROM s UNION ALL SELECT 1, count(*) FROM a UNION ALL SELECT 2, count(*) FROM b) WHERE trails > 0""",
    "resolve_names": f"""WITH {R.DEFS}, l AS (SELECT DISTINCT id, name, {_LANGC} AS fam, kind FROM defs),
t AS (SELECT DISTINCT fam, name, id FROM l WHERE kind <> 'method' AND fam IS NOT NULL AND fam <> 'php' QUALIFY row_number() OVER (PARTITION BY fam, name ORDER BY id) <= 64),
c AS (SELECT fam, name, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS candidates FROM t GROUP BY fam, name)
SELECT o.id, c.candidates FROM (SELECT DISTINCT id, name, fam FROM l WHERE kind = 'method') o JOIN c ON o.fam = c.fam AND o.name = c.name""",
    "content_dedup": "SELECT sha256(text) AS revision, count(*) AS copies FROM documents GROUP BY 1",
    "fingerprint_skip": """WITH t AS (SELECT DISTINCT member, generation, path, status, bytes, revision FROM files),
g AS (SELECT member, generation, count(*) AS n, md5(string_agg(concat_ws('|', coalesce(path, ''), coalesce(status, ''), coalesce(CAST(bytes AS VARCHAR), ''), coalesce(revision, '')), chr(10) ORDER BY path, status, bytes, revision)) AS h FROM t GROUP BY 1, 2)
SELECT member, count(DISTINCT h) AS scans, CAST(sum(n) AS BIGINT) AS files FROM g GROUP BY member""",
    "read_source": f"""WITH {R.FILES} SELECT CASE WHEN f.bytes IS NULL THEN 'metadata_error' WHEN f.bytes > 2097152 THEN 'resource_excluded' WHEN c.bytes IS NULL THEN 'read_error' WHEN regexp_matches(hex(c.bytes), '^(..)*00') THEN 'binary_excluded' ELSE 'read' END AS status, count(*) AS files
FROM f LEFT JOIN contents c ON c.revision = f.revision GROUP BY 1""",
    "region_faults": """WITH r AS (SELECT r.*, max(span_end) OVER (PARTITION BY file_id ORDER BY span_start, span_end, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM region_spans r),
x AS (SELECT region_id, file_id, CASE WHEN span_end <= span_start THEN 'empty' WHEN span_end - span_start > 4096 THEN 'too_long' WHEN span_end > octet_length(c.bytes) THEN 'outside' WHEN span_start < before THEN 'overlap' END AS fault FROM r LEFT JOIN contents c ON c.revision = r.revision)
SELECT region_id, file_id, fault FROM x WHERE fault IS NOT NULL""",
    "doctor": """SELECT 'files_without_body' AS probe, count(*) AS rows FROM (SELECT DISTINCT revision FROM files WHERE revision IS NOT NULL) WHERE revision NOT IN (SELECT revision FROM contents)
UNION ALL SELECT 'bodies_without_file', count(*) FROM contents WHERE revision NOT IN (SELECT revision FROM files WHERE revision IS NOT NULL)
UNION ALL SELECT 'definitions_without_file', count(*) FROM (SELECT DISTINCT id, file_id FROM definitions) WHERE file_id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'regions_without_definition', count(*) FROM (SELECT DISTINCT definition FROM region_spans WHERE definition IS NOT NULL) WHERE definition NOT IN (SELECT id FROM definitions)""",
    "vector_cache_lookup": "SELECT key, CASE WHEN arg_max(coalesce(len(vector), -1), touched) = -1 THEN NULL ELSE arg_max(coalesce(len(vector), -1), touched) END AS dims, max(touched) AS touched FROM vector_cache GROUP BY key",
}
