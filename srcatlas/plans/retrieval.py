"""Retrieval queries: lanes, fusion, filters, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as FP
from ..functions import text as FT
from ..operators import filters, fusion, reads
from ..operators import lanes as L
from ..operators import search as S
from ..session import table
from . import relations as R

TERMS = ["cache", "slow", "query"]
PHRASE = ["this", "small"]
NAMES = ["ring", "relay"]


def lane_any_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.any_terms(R.postings(spark, d), TERMS).select("id", "path", "score")


def lane_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.any_terms(R.postings(spark, d), TERMS, need_all=True).select("id", "path", "score")


def lane_phrase(spark: SparkSession, d: str) -> DataFrame:
    return L.phrase(R.postings(spark, d), PHRASE).select("id", "path", "score")


def lane_exact(spark: SparkSession, d: str) -> DataFrame:
    return L.exact(R.definitions(spark, d), "field2").select("id", "path", "span_start")


def lane_occurrence(spark: SparkSession, d: str) -> DataFrame:
    o = R.definitions(spark, d).select("file_id", "name", "span_start", "span_end", F.lit("declaration").alias("role"))
    r = table(spark, d, "region_spans").select("region_id", "file_id", "span_start", "span_end")
    return L.occurrence(r, o, "field2")


def lane_filename(spark: SparkSession, d: str) -> DataFrame:
    return L.filename(R.files(spark, d), NAMES).select("path", "score", "rank")


def lane_regex(spark: SparkSession, d: str) -> DataFrame:
    return L.regex_lines(R.regions(spark, d), r"^## [0-9]+\.[0-9]+")


_QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("path"), F.col("embedding").alias("vector"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.vector_topk(_vectors(spark, d), _QUERY, 20)


def lane_semantic(spark: SparkSession, d: str) -> DataFrame:
    return L.semantic(_vectors(spark, d), _QUERY).select("id", "path", "score", "rank")


def search(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.document_corpus(spark, d), " ".join(TERMS), limit=100).select("path", "score", "rank")


def postings_build(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the documents with the number of documents that hold them; the first query on a folder's documents builds their index."""
    return R.postings(spark, d).terms.select("term", "df")


def postings_code(spark: SparkSession, d: str) -> DataFrame:
    """The same of the regions of code."""
    return R.postings(spark, d, "code").terms.select("term", "df")


IDENTIFIER = "field2"


def search_identifier(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.code_corpus(spark, d), IDENTIFIER).select("rank", "path", "tier", "score")


def search_qualified(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.code_corpus(spark, d), f"Safe::{IDENTIFIER}").select("rank", "path", "tier", "score")


def search_literal(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.document_corpus(spark, d), '"' + " ".join(PHRASE) + '"').select("rank", "path", "score", "provenance")


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.code_corpus(spark, d), "return value lang:rust -file:gen kind:function").select("rank", "path", "tier", "score")


def search_symbol(spark: SparkSession, d: str) -> DataFrame:
    return S.search(R.code_corpus(spark, d), f"sym:{IDENTIFIER} lang:ts").select("rank", "path", "id")


def search_regex(spark: SparkSession, d: str) -> DataFrame:
    """A pattern that goes on over a line end."""
    return S.search(R.code_corpus(spark, d), r"re:;\n +let lang:rust").select("rank", "path", "span_start", "span_end")


def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    """All lanes over documents, the vector lane, and the first hits reordered by a score of their bodies; with snippets."""
    found = S.search(R.document_corpus(spark, d), " ".join(TERMS), vector=_QUERY, scorer=F.length("body").cast("double"), limit=100, snippets=True)
    return found.select("rank", "path", "score", "provenance", "line")


def _lane(df: DataFrame, no: int, prior: bool = False) -> DataFrame:
    p = fusion.path_prior(F.col("path"), TERMS) if prior else F.lit(1.0)
    return df.select(F.lit(no).alias("lane_no"), "path", "rank", F.lit(2.0 if no == 0 else 1.0).alias("weight"), p.alias("prior"), F.lit(0).alias("tier"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    r = R.postings(spark, d)
    return fusion.ranked(fusion.fuse(_lane(L.phrase(r, PHRASE), 0).unionByName(_lane(L.any_terms(r, TERMS), 1))))


def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("path", "score", "rank")


def refuse_semantic(spark: SparkSession, d: str) -> DataFrame:
    r = R.postings(spark, d)
    lane = L.any_terms(r, ["server"]).select("path", "rank")
    return fusion.ranked(fusion.refuse(_fused(spark, d), lane, fusion.path_prior(F.col("path"), TERMS))).select("path", "tier", "score", "rank")


def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank(_fused(spark, d), F.length("path").cast("double")).select("path", "final_rank")


def path_prior(spark: SparkSession, d: str) -> DataFrame:
    return R.files(spark, d).select("id", fusion.path_prior(F.col("path"), ["ring"]).alias("prior"))


def lane_weight(spark: SparkSession, d: str) -> DataFrame:
    lane = F.when(F.col("kind") == "class", "exact").when(F.col("kind") == "method", "file").otherwise("any")
    return R.definitions(spark, d).select("id", "file_id", fusion.lane_weight(lane, F.col("kind"), F.lit(3), True).alias("weight")).distinct()


def evidence_tier(spark: SparkSession, d: str) -> DataFrame:
    lane = F.when(F.col("kind") == "class", "exact").when(F.col("kind") == "method", "file").otherwise("any")
    return R.definitions(spark, d).select("kind", fusion.evidence_tier(lane, F.when(F.col("container").isNull(), 2).otherwise(3), True).alias("tier")).groupBy("kind", "tier").count()


def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "definitions").select(F.col("revision").alias("path"), "span_start", "span_end", "kind", F.col("id").alias("rank"))
    return fusion.dedup(hits)


def snippet_pick(spark: SparkSession, d: str) -> DataFrame:
    return fusion.snippets(R.regions(spark, d), TERMS)


def filter_language(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d)
    return f.where(FP.language_column(F.col("language")) == FP.canonical_language("TS")).select("id", "path")


def filter_kind(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply(R.definitions(spark, d), filters.parse_query("kind:method")).groupBy("member").agg(F.count("*").alias("methods"))


def filter_path(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_paths(R.files(spark, d), ["src", "lib/ring"], ["src/ring", "score"]).select("id", "path")


def filter_path_bind(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d)
    rows = [(v, filters.anchored(f, v)) for v in ("src", "ring", "lib", "no-such")]
    return spark.createDataFrame(rows, "value string, anchored boolean")


def filter_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return filters.diagnose(R.files(spark, d), ["core/", "no-such"], "rust")


def nearest_paths_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.nearest_paths(R.files(spark, d), "core/ringg.rs").select("path", "class", "distance", "rank")


def resolve_single_file(spark: SparkSession, d: str) -> DataFrame:
    f = R.files(spark, d)
    first = f.agg(F.min("path")).first()[0] or ""
    rows = [(v, filters.resolve_single_file(f, v)) for v in (first, first.rsplit("/", 1)[-1], "no-such.rs")]
    return spark.createDataFrame([(i, r) for i, (_, r) in enumerate(rows)], "n int, path string")


def classify_test_path(spark: SparkSession, d: str) -> DataFrame:
    return R.files(spark, d).select("id", FP.is_test_path(F.col("path")).alias("is_test"))


def classify_doc_path(spark: SparkSession, d: str) -> DataFrame:
    return R.files(spark, d).select("id", FP.is_doc_path(F.col("path")).alias("is_doc"))


def expand_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "definitions").select("name").distinct().select("name", FT.expand_identifiers(F.col("name")).alias("expanded"))


def line_span(spark: SparkSession, d: str) -> DataFrame:
    """Line on which the middle of each document's text stands."""
    t = table(spark, d, "documents")
    return t.select("doc_id", FT.text_line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("line"))


def show_path(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 4 of every document."""
    return reads.show_lines(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 2, 4).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        lane_any_terms, lane_all_terms, lane_phrase, lane_exact, lane_occurrence, lane_filename, lane_regex, vector_topk, lane_semantic, postings_build, postings_code, search, search_identifier, search_qualified, search_literal, search_filtered, search_symbol, search_regex, search_semantic, fuse_rrf, refuse_semantic,
        rerank_window, path_prior, lane_weight, evidence_tier, dedup_hits, snippet_pick, filter_language, filter_kind, filter_path, filter_path_bind, filter_diagnosis,
        nearest_paths_filter, resolve_single_file, classify_test_path, classify_doc_path, expand_identifiers, line_span, show_path,
    )
}

_COLS = ("name", "expanded", "body", "path")
_W = {"name": "8.0", "expanded": "2.0", "body": "1.0", "path": "0.5"}


def _count(col: str, t: str) -> str:
    return f"len(list_filter(t_{col}, lambda x: x = '{t}'))"


def _places(col: str, terms: list[str]) -> str:
    n = len(terms)
    return f"len(list_filter(range(1, len(t_{col}) - {n - 2}), lambda i: t_{col}[i:i+{n - 1}] = [{', '.join(repr(t) for t in terms)}]))"


def _any(name: str, terms: list[str], need_all: bool = False, base: str = "tok", where: str = "") -> str:
    """``where``: a condition on path, kind and language of what may be a hit; counts are of all regions."""
    freqs = ", ".join("(" + " + ".join(f"{_count(c, t)} * {_W[c]}" for c in _COLS) + f") AS f{i}" for i, t in enumerate(terms))
    length = " + ".join(f"len(t_{c})" for c in _COLS)
    dfs = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    cond = (" AND " if need_all else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    more, cond = (", kind, language", f"({cond}) AND {where}") if where else ("", cond)
    return f"""{name}_f AS (SELECT id, path{more}, {length} AS len, {freqs} FROM {base}),
{name}_s AS (SELECT count(*) AS n, avg(len) AS avg, {dfs} FROM {name}_f),
{name}_h AS (SELECT id, path, round({score}, 6) AS score FROM {name}_f, {name}_s WHERE {cond}),
{_top(name)}"""


def _top(name: str) -> str:
    return f"""{name}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM {name}_h) WHERE n = 1),
{name} AS (SELECT id, path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM {name}_b QUALIFY rank <= 1000)"""


def _phrase(name: str, terms: list[str], where: str = "true") -> str:
    places = " + ".join(f"{_places(c, terms)} * {_W[c]}" for c in _COLS)
    return f"{name}_h AS (SELECT id, path, score FROM (SELECT id, path, CAST({places} AS DOUBLE) AS score FROM tok WHERE {where}) WHERE score > 0),\n{_top(name)}"


def _filename(name: str, terms: list[str], source: str, where: str = "true") -> str:
    both = " AND ".join(f"contains(lower(split_part(path, '/', -1)), '{t}')" for t in terms)
    one = " OR ".join(f"contains(lower(path), '{t}')" for t in terms)
    stem = r"list_filter(regexp_split_to_array(regexp_replace(lower(split_part(path, '/', -1)), '\.[^.]*$', ''), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""{name} AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM (
  SELECT path, CASE WHEN {stem} = [{', '.join(repr(t) for t in terms)}] THEN 3 WHEN {both} THEN 2 WHEN {one} THEN 1 END AS score FROM (SELECT DISTINCT path FROM {source} WHERE {where}))
  WHERE score IS NOT NULL QUALIFY rank <= 1000)"""


_PRIOR_OFF = " AND ".join("contains(lower(split_part(path, '/', -1)), '{}')".format(t) for t in TERMS)
_PRIOR = f"CASE WHEN ({R.IS_TEST.format('path')} OR regexp_matches(lower(path), '\\.(md|markdown)$')) AND NOT ({_PRIOR_OFF}) THEN 0.7 ELSE 1.0 END"
_FUSED = (
    f"WITH {R.REGIONS},\n{_phrase('ph', PHRASE)},\n{_any('an', TERMS)},\n"
    "fu AS (SELECT path, round(coalesce(2.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM ph a FULL JOIN an b USING (path)),\n"
    "fr AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM fu)"
)
_SEM_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"
_Q = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
_COS = f"round(list_sum(list_transform(list_zip(embedding, {_Q}), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / ({_SEM_NORM} * sqrt(list_sum(list_transform({_Q}, lambda x: x * x)))), 6)"
_LANG = "CASE WHEN lower(trim(language)) IN ('typescript', 'ts', 'tsx') THEN 1 END = 1"


def _hit(value: str, anchored: bool) -> str:
    return f"starts_with(path, '{value}')" + ("" if anchored else f" OR contains(path, '/{value}')")


def _anchored(value: str) -> str:
    n = len(value)
    return f"(SELECT coalesce(bool_or(starts_with(path, '{value}') AND substr(path, {n + 1}, 1) IN ('', '/', '.')), false) FROM f)"


def _bound(value: str) -> str:
    return f"(starts_with(path, '{value}') OR (NOT {_anchored(value)} AND contains(path, '/{value}')))"


_SEARCH = (
    f"WITH {R.REGIONS},\n{_phrase('ph', TERMS)},\n{_any('al', TERMS, True)},\n{_any('an', TERMS)},\n{_filename('fi', TERMS, 'reg')},\n"
    f"hits AS (SELECT 0 AS lane, path, 2.0 / (60 + rank) AS t FROM ph UNION ALL SELECT 1, path, 1.0 / (60 + rank) FROM al UNION ALL SELECT 2, path, 1.0 / (60 + rank) FROM an UNION ALL SELECT 3, path, CASE WHEN score = 3 THEN 2.0 ELSE 0.5 END / (60 + rank) FROM fi),\n"
    f"su AS (SELECT path, round(list_sum(list_transform(array_agg(t ORDER BY lane), lambda x: x * ({_PRIOR}))), 9) AS score FROM hits GROUP BY path)\n"
    "SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM su QUALIFY rank <= 100"
)

def _stem_is(terms: list[str]) -> str:
    stem = r"list_filter(regexp_split_to_array(regexp_replace(lower(split_part(path, '/', -1)), '\.[^.]*$', ''), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"{stem} = [{', '.join(repr(t) for t in terms)}]"


def _lane_hits(lanes: list[tuple[str, str, str]], terms: list[str], identifier: bool) -> str:
    """Hits of (table, weight, tier), added in order, to rows path, tier, score, rank."""
    low = f"({R.IS_TEST.format('path')} OR regexp_matches(lower(path), '\\.(md|markdown)$'))"
    if not identifier:
        low += " AND NOT (" + " AND ".join(f"contains(lower(split_part(path, '/', -1)), '{t}')" for t in terms) + ")"
    union = " UNION ALL ".join(f"SELECT {no} AS lane, path, {weight} / (60 + rank) AS t, {tier} AS tier FROM {table}" for no, (table, weight, tier) in enumerate(lanes))
    named = f"CASE WHEN {_stem_is(terms)} THEN 0 ELSE min(tier) END" if identifier else "0"
    return f"""hits AS ({union}),
su AS (SELECT path, {named} AS tier, round(list_sum(list_transform(array_agg(t ORDER BY lane), lambda x: x * (CASE WHEN {low} THEN 0.7 ELSE 1.0 END))), 9) AS score FROM hits GROUP BY path)
SELECT row_number() OVER (ORDER BY tier, score DESC, path) AS rank, path, tier, score FROM su QUALIFY rank <= 10000"""


_LOCAL = "kind IN ('variable', 'parameter', 'import')"
_FILE_WEIGHT = "CASE score WHEN 3 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.5 END"


def _exact(name: str, where: str) -> str:
    return f"{name} AS (SELECT path, kind, row_number() OVER (ORDER BY path, span_start, span_end, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY span_start, span_end, id) AS n FROM cd WHERE {where}) WHERE n = 1 QUALIFY rank <= 1000)"


def _occurrences(name: str, of: str, qualifier: str | None = None) -> str:
    also = f" AND path IN (SELECT path FROM cd WHERE name = '{qualifier}')" if qualifier else ""
    return f"""{name} AS (SELECT path, row_number() OVER (ORDER BY uses DESC, path) AS rank FROM (SELECT r.path, count(DISTINCT (o.span_start, o.span_end)) AS uses FROM creg r
  JOIN (SELECT DISTINCT path, span_start, span_end FROM cd WHERE name = '{of}'{also}) o ON r.path = o.path AND r.span_start <= o.span_start AND o.span_end <= r.span_end GROUP BY r.path) QUALIFY rank <= 1000)"""


_CODE_FILTER = "lower(trim(language)) IN ('rust', 'rs') AND NOT " + _bound("gen").replace("FROM f)", "FROM cf)")
_FN = f"({_CODE_FILTER} AND kind = 'function')"
_IDENT_LANES = [("ex", f"CASE WHEN {_LOCAL} THEN 1.0 ELSE 3.0 END", f"CASE WHEN {_LOCAL} THEN 2 ELSE 1 END")]
_QUAL = f"""ql AS (SELECT id, path, kind, span_start, span_end, list_concat(string_split({R.SEGMENTS}, '/'), CASE WHEN container IS NULL THEN [] ELSE regexp_split_to_array(container, '::|[\\\\./]') END) AS owner FROM cd WHERE name = '{IDENTIFIER}'
  AND contains(concat_ws('/', coalesce(container, ''), replace(path, '-', '_')), 'Safe')),
qt AS (SELECT *, CASE WHEN owner[-1] = 'Safe' THEN 0 WHEN list_contains(owner, 'Safe') THEN 1 END AS t FROM ql),
qk AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY span_start, span_end, id) AS n FROM qt WHERE t = (SELECT min(t) FROM qt)),
qu AS (SELECT path, kind, row_number() OVER (ORDER BY CASE kind WHEN 'module' THEN 1 WHEN 'variant' THEN 2 WHEN 'field' THEN 2 WHEN 'constructor' THEN 2 WHEN 'variable' THEN 3 WHEN 'parameter' THEN 3 WHEN 'import' THEN 3 ELSE 0 END, {R.IS_TEST.format('path')}, path, span_start, span_end, id) AS rank FROM qk WHERE n = 1 QUALIFY rank <= 1000)"""

SQL = {
    "postings_build": f"WITH {R.REGIONS} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(list_concat(t_name, t_expanded, t_body, t_path)) AS term FROM tok) GROUP BY term",
    "postings_code": f"WITH {R.CODE} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(list_concat(t_name, t_expanded, t_body, t_path)) AS term FROM tok) GROUP BY term",
    "search_identifier": f"WITH {R.CODE},\n{_exact('ex', f"name = '{IDENTIFIER}'")},\n{_occurrences('oc', IDENTIFIER)},\n{_any('an', [IDENTIFIER])},\n{_filename('fi', [IDENTIFIER], 'cf')},\n"
    + _lane_hits([*_IDENT_LANES, ("oc", "1.0", "2"), ("an", "1.0", "3"), ("fi", _FILE_WEIGHT, "3")], [IDENTIFIER], True),
    "search_qualified": f"WITH {R.CODE},\n{_exact('ex', f"name = 'Safe::{IDENTIFIER}'")},\n{_QUAL},\n{_occurrences('oc', IDENTIFIER, 'Safe')},\n{_phrase('ph', ['safe', IDENTIFIER])},\n{_any('al', ['safe', IDENTIFIER], True)},\n{_any('an', ['safe', IDENTIFIER])},\n{_filename('fi', ['safe', IDENTIFIER], 'cf')},\n"
    + _lane_hits([*_IDENT_LANES, ("qu", *_IDENT_LANES[0][1:]), ("oc", "1.0", "2"), ("ph", "2.0", "3"), ("al", "1.0", "3"), ("an", "1.0", "3"), ("fi", _FILE_WEIGHT, "3")], ["safe", IDENTIFIER], True),
    "search_literal": f"WITH {R.REGIONS},\n{_phrase('ph', PHRASE)},\n{_lane_hits([('ph', '2.0', '0')], PHRASE, False)}".replace("SELECT row_number() OVER (ORDER BY tier, score DESC, path) AS rank, path, tier, score FROM su", "SELECT row_number() OVER (ORDER BY tier, score DESC, path) AS rank, path, score, 'phrase' AS provenance FROM su"),
    "search_filtered": f"WITH {R.CODE},\n{_exact('ex', "name = 'return value' AND " + _FN)},\n{_phrase('ph', ['return', 'value'], _FN)},\n{_any('al', ['return', 'value'], True, where=_FN)},\n{_any('an', ['return', 'value'], where=_FN)},\n"
    + _lane_hits([("ex", "1.0", "0"), ("ph", "2.0", "0"), ("al", "1.0", "0"), ("an", "1.0", "0")], ["return", "value"], False),
    "search_symbol": f"""WITH {R.CODE} SELECT row_number() OVER (ORDER BY CASE kind WHEN 'module' THEN 1 WHEN 'variant' THEN 2 WHEN 'field' THEN 2 WHEN 'constructor' THEN 2 WHEN 'variable' THEN 3 WHEN 'parameter' THEN 3 WHEN 'import' THEN 3 ELSE 0 END, {R.IS_TEST.format('path')}, path, span_start, span_end, id) AS rank, path, id
FROM cd WHERE name = '{IDENTIFIER}' AND lower(trim(language)) IN ('typescript', 'ts', 'tsx') QUALIFY rank <= 10000""",
    "search_regex": f"""WITH {R.CODE}, m AS (SELECT path, span_start, body, regexp_extract_all(body, ';\n +let') AS found, string_split_regex(body, ';\n +let') AS rest FROM creg WHERE lower(trim(language)) IN ('rust', 'rs') AND NOT contains(body, chr(0))),
e AS (SELECT path, span_start, found[i] AS hit, list_sum(list_transform(rest[1:i], lambda x: octet_length(encode(x)))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: octet_length(encode(x)))), 0) AS skip FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
h AS (SELECT DISTINCT path, CAST(span_start + skip AS BIGINT) AS span_start, CAST(span_start + skip + octet_length(encode(hit)) AS BIGINT) AS span_end FROM e)
SELECT row_number() OVER (ORDER BY path, span_start, span_end) AS rank, path, span_start, span_end FROM h QUALIFY rank <= 10000""",
    "lane_any_terms": f"WITH {R.REGIONS},\n{_any('an', TERMS)} SELECT id, path, score FROM an",
    "lane_all_terms": f"WITH {R.REGIONS},\n{_any('an', TERMS, True)} SELECT id, path, score FROM an",
    "lane_phrase": f"WITH {R.REGIONS},\n{_phrase('ph', PHRASE)} SELECT id, path, score FROM ph",
    "lane_exact": f"WITH {R.DEFS} SELECT id, path, span_start FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY span_start, span_end, id) AS n FROM defs WHERE name = 'field2') WHERE n = 1 ORDER BY path LIMIT 1000",
    "lane_occurrence": f"""WITH {R.DEFS},
o AS (SELECT file_id, count(*) AS uses, arg_min(struct_pack(a := span_start, b := span_end), (span_start, span_end)) AS best FROM defs WHERE name = 'field2' GROUP BY file_id),
r AS (SELECT r.file_id, r.region_id, o.uses, row_number() OVER (PARTITION BY r.file_id ORDER BY r.span_end - r.span_start, r.region_id) AS n
  FROM region_spans r JOIN o ON o.file_id = r.file_id AND r.span_start <= o.best.a AND o.best.b <= r.span_end)
SELECT file_id, region_id, uses FROM r WHERE n = 1 ORDER BY uses DESC, file_id LIMIT 1000""",
    "lane_filename": f"WITH {R.FILES},\n{_filename('fi', NAMES, 'f')} SELECT path, score, rank FROM fi",
    "lane_regex": r"""SELECT id, line, text FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
WHERE regexp_matches(text, '^## [0-9]+\.[0-9]+') ORDER BY id, line LIMIT 10000""",
    "vector_topk": f"SELECT vec_id AS id, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 20",
    "lane_semantic": f"WITH an_h AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS path, {_COS} AS score FROM embeddings), {_top('an')} SELECT id, path, score, rank FROM an",
    "search": _SEARCH,
    "fuse_rrf": _FUSED + " SELECT path, score, rank FROM fr",
    "refuse_semantic": _FUSED
    + f""",\n{_any('sv', ['server'])},
re AS (SELECT coalesce(fr.path, sv.path) AS path, CASE WHEN fr.path IS NULL THEN 3 ELSE 0 END AS tier, coalesce(1.0 / (60 + fr.rank), 0) AS a, coalesce(1.0 / (60 + sv.rank), 0) AS b FROM fr FULL JOIN sv ON fr.path = sv.path),
rs AS (SELECT path, tier, round(a + b * ({_PRIOR}), 9) AS score FROM re)
SELECT path, tier, score, row_number() OVER (ORDER BY tier, score DESC, path) AS rank FROM rs""",
    "rerank_window": _FUSED + " SELECT path, CASE WHEN rank <= 32 THEN row_number() OVER (PARTITION BY rank <= 32 ORDER BY length(path) DESC, rank) ELSE rank END AS final_rank FROM fr",
    "path_prior": f"WITH {R.FILES} SELECT id, CASE WHEN ({R.IS_TEST.format('path')} OR regexp_matches(lower(path), '\\.(md|markdown)$')) AND NOT contains(lower(split_part(path, '/', -1)), 'ring') THEN 0.7 ELSE 1.0 END AS prior FROM f",
    "lane_weight": f"WITH {R.DEFS} SELECT DISTINCT id, file_id, CASE kind WHEN 'class' THEN 3.0 WHEN 'method' THEN 2.0 ELSE 1.0 END AS weight FROM defs",
    "evidence_tier": f"WITH {R.DEFS} SELECT kind, tier, count(*) AS count FROM (SELECT kind, CASE WHEN kind = 'method' AND container IS NOT NULL THEN 0 WHEN kind = 'class' THEN 1 ELSE 3 END AS tier FROM defs) GROUP BY ALL",
    "dedup_hits": "SELECT revision AS path, span_start, span_end, kind, min(id) AS rank FROM definitions GROUP BY ALL ORDER BY rank, path, span_start, span_end, kind LIMIT 10000",
    "snippet_pick": r"""WITH l AS (SELECT doc_id AS id, lower(coalesce(topic, '')) AS name, unnest(string_split(text, chr(10))[1:2000]) AS t, unnest(range(1, least(2000, len(string_split(text, chr(10)))) + 1)) AS line FROM documents),
e AS (SELECT id, line, t, """
    + " + ".join(f"contains(lower(t), '{x}')::INT" for x in TERMS)
    + r""" AS found, name <> '' AND contains(lower(t), name) AS named, regexp_matches(t, '^\s*(//|/\*|\*|#|--|;)') AS com FROM l WHERE regexp_matches(t, '\S')),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -(2 * found + CASE WHEN found > 0 AND NOT com THEN 3 ELSE 0 END), CASE WHEN found > 0 AND NOT com THEN 0 WHEN found = 0 AND named AND NOT com THEN 1 WHEN found > 0 THEN 2 WHEN named THEN 3 WHEN NOT com THEN 4 ELSE 5 END, line) AS n FROM e),
c AS (SELECT id, line, regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '[\x00-\x1f\x7f]', ' ', 'g') AS t FROM b WHERE n = 1)
SELECT id, line, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS snippet FROM c""",
    "filter_language": f"WITH {R.FILES} SELECT id, path FROM f WHERE {_LANG}",
    "filter_kind": f"WITH {R.DEFS} SELECT member, count(*) AS methods FROM defs WHERE kind = 'method' GROUP BY member",
    "filter_path": f"WITH {R.FILES} SELECT id, path FROM f WHERE ({_bound('src')} OR {_bound('lib/ring')}) AND NOT {_bound('src/ring')} AND NOT {_bound('score')}",
    "filter_path_bind": f"WITH {R.FILES} " + " UNION ALL ".join(f"SELECT '{v}' AS value, {_anchored(v)} AS anchored" for v in ("src", "ring", "lib", "no-such")),
    "filter_diagnosis": f"""WITH {R.FILES},
t AS (SELECT {_hit('core/', False)} AS a, {_hit('no-such', False)} AS b, coalesce(lower(trim(language)) IN ('rust', 'rs'), false) AS c FROM f),
s AS (SELECT coalesce(sum(a::INT), 0) AS a, coalesce(sum(b::INT), 0) AS b, coalesce(sum(c::INT), 0) AS c, coalesce(sum(((a OR b) AND c)::INT), 0) AS e FROM t)
SELECT 'file:core/' AS filter, a AS files FROM s UNION ALL SELECT 'file:no-such', b FROM s UNION ALL SELECT 'lang:rust', c FROM s UNION ALL SELECT 'all', e FROM s""",
    "nearest_paths_filter": f"""WITH {R.FILES},
p AS (SELECT DISTINCT path FROM f WHERE contains(lower(path), 'ring') ORDER BY length(path), path LIMIT 400),
q AS (SELECT path, split_part(lower(split_part(path, '/', -1)), '.', 1) AS s FROM p),
r AS (SELECT path, CASE WHEN s = 'ringg' THEN 0 WHEN contains(s, 'ringg') THEN 1 WHEN contains(lower(path), 'ringg') THEN 2 ELSE 3 END AS class, levenshtein(s, 'ringg') AS distance, len(string_split(path, '/')) AS depth FROM q)
SELECT path, class, distance, row_number() OVER (ORDER BY class, distance, depth, length(path), path) AS rank FROM r QUALIFY rank <= 3""",
    "resolve_single_file": f"""WITH {R.FILES}, p AS (SELECT DISTINCT path FROM f), a AS (SELECT min(path) AS first, split_part(min(path), '/', -1) AS base FROM p),
m AS (SELECT min(path) AS path, count(*) AS n FROM p, a WHERE path = base OR ends_with(path, '/' || base) OR (starts_with(split_part(path, '/', -1), base || '.') AND NOT contains(substr(split_part(path, '/', -1), length(base) + 2), '.')))
SELECT 0 AS n, first AS path FROM a UNION ALL SELECT 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE path = base) THEN base WHEN m.n = 1 THEN m.path END FROM a, m UNION ALL SELECT 2, NULL""",
    "classify_test_path": f"WITH {R.FILES} SELECT id, {R.IS_TEST.format('path')} AS is_test FROM f",
    "classify_doc_path": f"WITH {R.FILES} SELECT id, regexp_matches(lower(path), '\\.(md|markdown)$') AS is_doc FROM f",
    "expand_identifiers": f"SELECT DISTINCT name, {R.EXPAND.format('name')} AS expanded FROM definitions",
    "line_span": "SELECT doc_id, 1 + length(h) - length(replace(h, chr(10), '')) AS line FROM (SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) AS h FROM documents)",
    "show_path": "SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) WHERE line BETWEEN 2 AND 4",
}
