"""The relations that the core queries run on, made from the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expand_identifiers
from ..operators import corpus
from ..operators.postings import Postings
from ..operators.search import Corpus
from ..session import table


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as regions of files: a member's texts of one source and topic make a file."""
    t = table(spark, d, "documents")
    path = F.concat_ws("/", "member", F.lower(F.trim("source")), F.concat(F.coalesce("topic", F.lit("none")), F.lit(".md")))
    return t.select(F.col("doc_id").alias("id"), path.alias("path"), F.coalesce("topic", F.lit("")).alias("name"), expand_identifiers(F.coalesce("topic", F.lit(""))).alias("expanded"), F.col("text").alias("body"))


_indexes: dict[tuple[str, str, str], Postings] = {}


def postings(spark: SparkSession, d: str, name: str = "documents") -> Postings:
    """The index of a relation's regions: built once in an application for a folder, whose tables don't change."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _indexes:
        _indexes[key] = Postings.build({"documents": regions, "code": code_regions}[name](spark, d))
    return _indexes[key]


def code_regions(spark: SparkSession, d: str) -> DataFrame:
    """The current files' regions with their text; those that aren't UTF-8, or not within their body, are left out."""
    f = files(spark, d).where("revision IS NOT NULL").select(F.col("id").alias("file_id"), F.concat_ws("/", "member", "path").alias("path"), "language", "revision")
    r = table(spark, d, "region_spans").select(F.col("region_id").alias("id"), "file_id", "revision", "span_start", "span_end", "definition").distinct()
    # each body is shuffled once, with the distinct spans that cut it
    spans = r.groupBy("revision").agg(F.collect_set(F.struct("span_start", "span_end")).alias("spans"))
    cut = table(spark, d, "contents").join(spans.hint("shuffle_hash"), "revision").select("revision", "bytes", F.explode("spans").alias("s"))
    cut = cut.where("s.span_start >= 0 AND s.span_start < s.span_end AND s.span_end <= length(bytes)")
    cut = cut.select("revision", "s.*", F.expr("CAST(substring(bytes, CAST(s.span_start AS INT) + 1, CAST(s.span_end - s.span_start AS INT)) AS STRING)").alias("body")).where(F.is_valid_utf8("body"))
    names = table(spark, d, "definitions").groupBy(F.col("id").alias("definition"), "file_id", "revision").agg(F.min(F.struct("name", "kind")).alias("d"))
    x = r.join(f, ["file_id", "revision"]).join(names, ["definition", "file_id", "revision"], "left").join(cut, ["revision", "span_start", "span_end"])
    name = F.coalesce("d.name", F.lit(""))
    return x.select("id", "file_id", "path", "language", name.alias("name"), expand_identifiers(name).alias("expanded"), F.coalesce("d.kind", F.lit("region")).alias("kind"), "span_start", "span_end", "body")


def code_corpus(spark: SparkSession, d: str) -> Corpus:
    """Files, definitions and regions of all members; a definition is the only known occurrence of its name."""
    f = files(spark, d).select(F.concat_ws("/", "member", "path").alias("path"), "language")
    x = definitions(spark, d).withColumn("path", F.concat_ws("/", "member", "path"))
    o = x.select("path", "name", "span_start", "span_end", F.lit("declaration").alias("role"))
    return Corpus(code_regions(spark, d), f, x, o, None, postings(spark, d, "code"))


def document_corpus(spark: SparkSession, d: str) -> Corpus:
    """Documents; the embedding of the same number is a document's vector."""
    r = regions(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(r.select("id", "path"), "id")
    return Corpus(r, None, None, None, v, postings(spark, d))


def files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current(table(spark, d, "files"))


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct definitions of the current files with their path, member and reported language."""
    f = files(spark, d).select(F.col("id").alias("file_id"), "path", "member", "language", "revision")
    t = table(spark, d, "definitions").select("id", "file_id", "name", "kind", "span_start", "span_end", "container", "revision").distinct()
    return t.join(f, ["file_id", "revision"])


T = r"regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\p{{L}}\p{{N}}]+')"
FILES = """
cur AS (SELECT id, arg_max(struct_pack(member := member, path := path, revision := revision, language := language, status := status, bytes := bytes, generation := generation, observed_at := observed_at),
  coalesce(generation, -1)) AS r FROM files WHERE id IS NOT NULL GROUP BY id),
f AS (SELECT id, r.member AS member, r.path AS path, r.revision AS revision, r.language AS language, r.status AS status, r.bytes AS bytes, r.generation AS generation FROM cur)"""
DEFS = (
    FILES
    + """,
defs AS (SELECT d.id, d.file_id, d.name, d.kind, d.span_start, d.span_end, d.container, d.revision, f.path, f.member, f.language
  FROM (SELECT DISTINCT id, file_id, name, kind, span_start, span_end, container, revision FROM definitions) d JOIN f ON f.id = d.file_id AND f.revision = d.revision)"""
)
EXPAND = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]', ' ', 'g'))"
REGIONS = (
    """
reg AS (SELECT doc_id AS id, concat_ws('/', member, lower(trim(source)), coalesce(topic, 'none') || '.md') AS path, coalesce(topic, '') AS name, """
    + EXPAND.format("coalesce(topic, '')")
    + """ AS expanded, text AS body FROM documents),
tok AS (SELECT id, path, body, """
    + ", ".join(T.format(c) + f" AS t_{c}" for c in ("name", "expanded", "body", "path"))
    + " FROM reg)"
)
SEGMENTS = r"array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '\.[^./]*$', ''), '/'), lambda x: x NOT IN ('src', 'mod', 'lib', 'main', 'index')), lambda x: replace(x, '-', '_')), '/')"
CODE = (
    DEFS
    + """,
dn AS (SELECT id, file_id, revision, min(struct_pack(name := name, kind := kind)) AS d FROM definitions GROUP BY id, file_id, revision),
sp AS (SELECT DISTINCT region_id AS id, file_id, revision, span_start, span_end, definition FROM region_spans),
creg AS (SELECT s.id, s.file_id, concat_ws('/', f.member, f.path) AS path, f.language, coalesce(dn.d.name, '') AS name, """
    + EXPAND.format("coalesce(dn.d.name, '')")
    + """ AS expanded, coalesce(dn.d.kind, 'region') AS kind, s.span_start, s.span_end, try(decode(c.bytes[s.span_start + 1:s.span_end])) AS body
  FROM sp s JOIN f ON f.id = s.file_id AND f.revision = s.revision JOIN contents c ON c.revision = s.revision
  LEFT JOIN dn ON dn.id = s.definition AND dn.file_id = s.file_id AND dn.revision = s.revision
  WHERE s.span_start >= 0 AND s.span_start < s.span_end AND s.span_end <= octet_length(c.bytes) AND try(decode(c.bytes[s.span_start + 1:s.span_end])) IS NOT NULL),
tok AS (SELECT id, path, kind, language, """
    + ", ".join(T.format(c) + f" AS t_{c}" for c in ("name", "expanded", "body", "path"))
    + """ FROM creg),
cf AS (SELECT concat_ws('/', member, path) AS path, language FROM f),
cd AS (SELECT id, concat_ws('/', member, path) AS path, name, kind, container, language, span_start, span_end FROM defs)"""
)
IS_TEST = r"(regexp_matches(lower({0}), '(^|/)(tests|__tests__|spec|testdata)/') OR (regexp_matches(lower({0}), '(^|/)test/[^/]+') AND NOT regexp_matches(lower({0}), '(^|/)test/src/')) OR regexp_matches(lower({0}), '(^|/)([^/.]*_)?tests(\.[^/]*)?$') OR regexp_matches(lower({0}), '(^|/)[^/]*\.(test|spec)\.[^/]*$') OR regexp_matches(lower({0}), '_test\.(go|py)$') OR regexp_matches(lower({0}), '(^|/)test_[^/]*\.py$') OR regexp_matches(lower({0}), '_spec\.rb$'))"
