"""Retrieval lanes: each gives at most one row per path, in rank order.

A lane reads its table once: terms are counted inside the row, so nothing is exploded and nothing is shuffled but one row per hit path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import basename
from ..functions.text import count_phrase, count_token, count_tokens, fold, lowered
from .postings import COLUMN_WEIGHTS, K1, B, Postings, idf, lane

LANE_FILES = 1000


def query_terms(text: str) -> list[str]:
    """Folded letter and digit runs, as the index has them, in order."""
    return re.findall(r"[^\W_]+", fold(text))


def name_terms(text: str) -> list[str]:
    """Terms that file names are compared with: letter and digit runs in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def word_terms(text: str) -> list[str]:
    """Words of a query: letters, digits and '_'; one with '_' means its parts one after the other."""
    return re.findall(r"\w+", text)


def snippet_terms(text: str) -> list[str]:
    """Distinct words of at least two bytes."""
    return list(dict.fromkeys(w.lower() for w in word_terms(text) if len(w.encode()) >= 2))


def concept(text: str) -> dict:
    """Expressions of a free-text query: phrase, all terms, any terms, identifier (name, and its qualifier).

    A text in double quotes with none inside is only a phrase; two or more words give phrase, all and
    any; one gives any.  One token of identifiers joined by '::', or with '_', a digit or a capital after a small letter,
    and a letter, is an identifier: ``a::b::c`` names ``c`` in ``b``.
    """
    t = text.strip()
    literal = len(t) > 1 and t[0] == t[-1] == '"' and '"' not in t[1:-1]
    if literal:
        return {"phrase": query_terms(t), "all": [], "any": [], "identifier": None, "name": None, "qualifier": None, "segments": [], "literal": True}
    parts = t.split("::")
    code = all(re.fullmatch(r"\w+", x) for x in parts) and any(map(str.isalpha, t))
    code = code and (len(parts) > 1 or "_" in t or any(map("0123456789".__contains__, t)) or any(a.islower() and b.isupper() for a, b in zip(t, t[1:])))
    terms, many = list(dict.fromkeys(query_terms(t))), len(word_terms(t)) > 1
    return {
        "phrase": query_terms(t) if many else [], "all": terms if many else [], "any": terms, "identifier": t if code else None,
        "name": parts[-1] if code else None, "qualifier": parts[-2] if code and len(parts) > 1 else None, "segments": parts if code else [], "literal": False,
    }


def exact(definitions: DataFrame, name: str, limit: int = LANE_FILES) -> DataFrame:
    """First definition per path whose name equals the text, case-sensitively; in path order."""
    w = Window.partitionBy("path").orderBy("span_start", "span_end", "id")
    hit = definitions.where(F.col("name") == name).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return hit.orderBy("path").limit(limit)


def _lowered(regions: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Regions with their texts in lower case; terms are counted in these by expressions that make no arrays."""
    cols = [c for c in COLUMN_WEIGHTS if c in regions.columns]
    return regions.select("id", "path", *[lowered(F.col(c)).alias(f"t_{c}") for c in cols]), {c: F.col(f"t_{c}") for c in cols}


def term_stats(regions: DataFrame, terms: list[str]) -> dict:
    """Regions, average length, and regions per term: one pass, one row."""
    regions, cols = _lowered(regions)
    length = sum((count_tokens(c) for c in cols.values()), F.lit(0))
    has = [F.sum(F.when(sum((count_token(c, t) for c in cols.values()), F.lit(0)) > 0, 1).otherwise(0)).alias(f"d{i}") for i, t in enumerate(terms)]
    row = regions.agg(F.count("*").alias("n"), F.avg(length).alias("avg"), *has).first()
    return {"n": row["n"], "avg": row["avg"] or 1.0, "df": {t: row[f"d{i}"] or 0 for i, t in enumerate(terms)}}


def any_terms(regions: DataFrame | Postings, terms: list[str], need_all: bool = False, limit: int = LANE_FILES) -> DataFrame:
    """Best region per path by weighted term relevance; with ``need_all`` only regions that hold every term.

    ``regions``: their index, or id, path and any of name, expanded, body, which are then read as a whole.
    Adds score (6 digits) and rank; ties by path, id.
    """
    if isinstance(regions, Postings):
        best = lane(regions.paths([[t] for t in terms]), "all" if need_all else "any", limit)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    if not terms:
        return regions.select("id", "path", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    stats = term_stats(regions, terms)
    regions, cols = _lowered(regions)
    length = sum((count_tokens(c) for c in cols.values()), F.lit(0))
    freq = [sum((count_token(c, t) * COLUMN_WEIGHTS[k] for k, c in cols.items()), F.lit(0.0)) for t in terms]
    hits = regions.select("id", "path", length.alias("len"), *[f.alias(f"f{i}") for i, f in enumerate(freq)])
    test: Column = F.lit(need_all)
    for i in range(len(terms)):
        test = test & (F.col(f"f{i}") > 0) if need_all else test | (F.col(f"f{i}") > 0)
    norm = K1 * (1 - B + B * F.col("len") / F.lit(float(stats["avg"])))
    score = sum((F.lit(idf(stats["n"], stats["df"][t])) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm) for i, t in enumerate(terms)), F.lit(0.0))
    return _best(hits.where(test).select("id", "path", F.round(score, 6).alias("score")), limit)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """Best row per path by an aggregate, then the top ``limit`` paths with their rank."""
    one = scored.groupBy("path").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")).select("path", "b.id", "b.score")
    top = one.orderBy(F.desc("score"), "path").limit(limit)
    return top.select("id", "path", "score", F.row_number().over(Window.orderBy(F.desc("score"), "path")).alias("rank"))


def phrase(regions: DataFrame | Postings, terms: list[str], limit: int = LANE_FILES) -> DataFrame:
    """Regions in one column of which the terms are adjacent; score is the number of such places times the column's weight."""
    if isinstance(regions, Postings):
        best = lane(regions.paths([], terms), "phrase", limit)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    regions, cols = _lowered(regions)
    places = sum((count_phrase(c, terms) * COLUMN_WEIGHTS[k] for k, c in cols.items()), F.lit(0.0))
    return _best(regions.select("id", "path", places.alias("score")).where("score > 0"), limit)


def occurrence(regions: DataFrame, occurrences: DataFrame, name: str, limit: int = LANE_FILES) -> DataFrame:
    """Per file, the region that contains the best occurrence of a name (declaration, other, import), files by use count.

    ``regions``: region_id, file_id, span_start, span_end; ``occurrences``: file_id, name, span_start, span_end, role.
    The containment join keeps its equality on the file.
    """
    role = F.when(F.col("role") == "declaration", 0).when(F.col("role") == "import", 2).otherwise(1)
    o = occurrences.where(F.col("name") == name).select("file_id", F.col("span_start").alias("a"), F.col("span_end").alias("b"), role.alias("tier"))
    uses = o.groupBy("file_id").agg(F.count("*").alias("uses"), F.min_by(F.struct("a", "b"), F.struct("tier", "a", "b")).alias("best"))
    inside = regions.join(uses.hint("shuffle_hash"), "file_id").where("span_start <= best.a AND best.b <= span_end")
    one = inside.groupBy("file_id").agg(F.min_by("region_id", F.struct(F.col("span_end") - F.col("span_start"), "region_id")).alias("region_id"), F.first("uses").alias("uses"))
    return one.orderBy(F.desc("uses"), "file_id").limit(limit)


def filename_score(path: Column, terms: list[str]) -> Column:
    """3: the words of the name without extension are the terms; 2: all terms in the name; 1: one in the path; null: none."""
    if not terms:
        return F.lit(1)
    name = F.lower(basename(path))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    words = F.filter(F.split(stem, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    everyone: Column = F.lit(True)
    someone: Column = F.lit(False)
    for t in terms:
        everyone = everyone & name.contains(t)
        someone = someone | F.lower(path).contains(t)
    return F.when(words == F.array(*[F.lit(t) for t in terms]), 3).when(everyone, 2).when(someone, 1)


def filename(files: DataFrame, terms: list[str], limit: int = LANE_FILES) -> DataFrame:
    hit = files.select("path").distinct().withColumn("score", filename_score(F.col("path"), terms)).where("score IS NOT NULL")
    top = hit.orderBy(F.desc("score"), "path").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def regex_matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(id, line, start, end, text): the matches of a pattern in whole texts, the first that begins on each line; offsets are bytes of UTF-8.

    Line anchors hold at every line, and a match may go on over line ends.  Texts are tested in the JVM, and only those that match go
    to Python for the places; the pattern must mean the same to both (no possessive or atomic groups, no classes of one of them alone).
    """
    finder = re.compile(pattern, re.M)
    hit = texts.where(F.col("body").isNotNull() & ~F.contains("body", F.lit("\0")) & F.col("body").rlike("(?m)" + pattern)).select("id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line, at, size, last = 1, 0, 0, 0
                for m in finder.finditer(body):
                    between = body[at : m.start()]
                    line, size, at = line + between.count("\n"), size + len(between.encode()), m.start()
                    if line != last:
                        last = line
                        for col, x in zip(out, (i, line, size, size + len(m[0].encode()), m[0])):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "line", "start", "end", "text"])

    return hit.select(F.col("id").cast("long"), "body").mapInArrow(run, "id long, line long, start long, end long, text string")


def regex_lines(texts: DataFrame, pattern: str, limit: int = 10000) -> DataFrame:
    """(id, line, text): each line on which a match begins, whole."""
    found = regex_matches(texts, pattern).join(texts.select("id", F.split("body", "\n").alias("lines")), "id")
    return found.select("id", "line", F.get("lines", F.col("line").cast("int") - 1).alias("text")).orderBy("id", "line").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score) of the k most similar finite vectors, ties by id: one pass and a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = (F.size("vector") == len(query)) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    scored = vectors.where(usable).select("id", F.round(cosine(F.col("vector"), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def semantic(vectors: DataFrame, query: list[float], limit: int = LANE_FILES) -> DataFrame:
    """Best vector per path (tie: lower id), top paths, with rank.  ``vectors``: id, path, vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size("vector") == len(query)).select("id", "path", F.round(cosine(F.col("vector"), q), 6).alias("score"))
    return _best(scored.where("score IS NOT NULL"), limit)
