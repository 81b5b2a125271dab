"""Fusion of lanes: reciprocal ranks, priors, evidence tiers, de-duplication, snippets, and the search pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import basename, is_doc_path, is_test_name, is_test_path
from . import lanes as L

# The constant of reciprocal ranks, the prior, words that ask for tests and documents, kinds that are no declarations.
RRF_K = 60
PRIOR = 0.7
TEST_WORDS = {"test", "tests", "testing", "spec", "fixture", "fixtures"}
DOC_WORDS = {"doc", "docs", "documentation", "readme", "markdown", "md", "agents", "claude", "guide"}
LOCAL_KINDS = ("variable", "parameter", "import")


def lane_weight(lane: Column, kind: Column, score: Column, identifier: bool) -> Column:
    """3 for exact non-local declarations of an identifier; 2 for phrases and whole file names; 0.5 for partial ones; else 1."""
    w = F.when((lane == "exact") & F.lit(identifier) & ~F.coalesce(kind.isin(*LOCAL_KINDS), F.lit(False)), 3.0)
    return w.when((lane == "phrase") | (lane == "file") & (score == 3), 2.0).when(lane == "file", 0.5).otherwise(1.0)


def evidence_tier(lane: Column, score: Column, identifier: bool) -> Column:
    """For identifier queries 0 named, 1 defined, 2 used, 3 absent; 0 for all others."""
    if not identifier:
        return F.lit(0)
    return F.when((lane == "file") & (score == 3), 0).when(lane == "exact", 1).when(lane == "occurrence", 2).otherwise(3)


def _asks_tests(value: str) -> bool:
    """Whether a path value of a filter is that of a test, or has a directory of tests."""
    parts = [p for p in value.split("/") if p]
    return is_test_name(value) or any(is_test_name(p + "/x") for p in parts)


def path_prior(path: Column, terms: list[str], filters: list[str] | None = None, identifier: bool = False, kind: str | None = None, language: str | None = None) -> Column:
    """0.7 for tests and for documents that the query doesn't ask for, by a word, or by a filter that is of that class; else 1.

    A filter lifts only the class it names: a test path or directory, a document or a folder ``doc`` or ``docs``; ``lang:text`` lifts documents,
    ``kind:file`` both.  Unless the query is an identifier, a file whose name holds all its terms has 1.
    """
    values = [v.lower() for v in filters or []]
    tests = kind != "file" and not TEST_WORDS & set(terms) and not any(map(_asks_tests, values))
    asks_docs = any(v.endswith((".md", ".markdown")) or {"doc", "docs"} & set(v.split("/")) for v in values)
    docs = kind != "file" and not DOC_WORDS & set(terms) and language != "text" and not asks_docs
    low = (F.lit(tests) & is_test_path(path)) | (F.lit(docs) & is_doc_path(path))
    named: Column = F.lit(bool(terms) and not identifier)
    for t in terms:
        named = named & F.lower(basename(path)).contains(t)
    return F.when(low & ~named, PRIOR).otherwise(1.0)


def collapse(lane: DataFrame, limit: int = L.LANE_FILES) -> DataFrame:
    """First row per path of a lane with ``rank``; ranks counted anew among the paths kept."""
    one = lane.groupBy("path").agg(F.min("rank").alias("r"))
    return one.orderBy("r", "path").limit(limit).select("path", F.row_number().over(Window.orderBy("r", "path")).alias("rank"))


def fuse(hits: DataFrame) -> DataFrame:
    """(lane_no, path, rank, weight, prior, tier) -> (path, tier, score), best first.

    The terms of a path are added in the order of the lanes, so the sum doesn't depend on the plan.
    """
    term = F.col("weight") * F.col("prior") / (RRF_K + F.col("rank"))
    parts = hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lane_no", term.alias("t")))).alias("p"), F.min("tier").alias("tier"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["t"])
    return parts.select("path", "tier", F.round(total, 9).alias("score")).orderBy("tier", F.desc("score"), "path")


def ranked(fused: DataFrame) -> DataFrame:
    return fused.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "path")))


def refuse(fused: DataFrame, lane: DataFrame, prior: Column) -> DataFrame:
    """The ranking fused again with one more lane, both at weight 1; the prior applies to the new lane only, tiers are kept."""
    a = fused.select(F.lit(0).alias("lane_no"), "path", "rank", F.lit(1.0).alias("weight"), F.lit(1.0).alias("prior"), "tier")
    tiers = fused.select("path", F.col("tier").alias("had"))
    b = lane.join(tiers, "path", "left").select(F.lit(1).alias("lane_no"), "path", "rank", F.lit(1.0).alias("weight"), prior.alias("prior"), F.coalesce("had", F.lit(3)).alias("tier"))
    return fuse(a.unionByName(b))


def rerank(ranking: DataFrame, scorer: Callable[[pd.Series], pd.Series] | Column, window: int = 32) -> DataFrame:
    """The first ``window`` rows reordered by (tier, score descending with unscored last, rank); the tail is unchanged.

    ``scorer``: a column, or a vectorised function of ``body``.
    """
    head = ranking.where(F.col("rank") <= window)
    s = scorer if isinstance(scorer, Column) else F.pandas_udf(scorer, "double")("body")
    head = head.withColumn("rerank_score", s)
    w = Window.orderBy("tier", F.col("rerank_score").desc_nulls_last(), "rank")
    head = head.withColumn("final_rank", F.row_number().over(w))
    tail = ranking.where(F.col("rank") > window).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("rank"))
    return head.unionByName(tail)


def dedup(hits: DataFrame, limit: int = 10000) -> DataFrame:
    """First row by rank per (path, span_start, span_end, kind)."""
    key = ["path", "span_start", "span_end", "kind"]
    one = hits.groupBy(*key).agg(F.min("rank").alias("rank"))
    return one.orderBy("rank", *key).limit(limit)


COMMENT = r"^\s*(//|/\*|\*|#|--|;)"


def snippets(texts: DataFrame, terms: list[str], most_lines: int = 2000, width: int = 120) -> DataFrame:
    """(id, line, snippet): the line with most evidence - twice its distinct terms, 3 more for code that has one - then class, then first.

    Classes: 0 term in code, 1 name in code, 2 term in a comment, 3 name in a comment, 4 other code, 5 other comment.  ``texts``: id, body and, where
    hits are named, name.  Blank lines never count; the first ``most_lines`` lines of a text are looked at, which is the feature's own bound.
    """
    name = F.lower(F.coalesce("name", F.lit(""))) if "name" in texts.columns else F.lit("")
    lines = texts.select("id", name.alias("name"), F.posexplode(F.slice(F.split("body", "\n"), 1, most_lines)).alias("n", "text")).where(F.col("text").rlike(r"\S"))
    low = F.lower("text")
    found = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    named = (F.col("name") != "") & low.contains(F.col("name"))
    comment = F.col("text").rlike(COMMENT)
    klass = F.when((found > 0) & ~comment, 0).when((found == 0) & named & ~comment, 1).when(found > 0, 2).when(named, 3).when(~comment, 4).otherwise(5)
    evidence = 2 * found + F.when((found > 0) & ~comment, 3).otherwise(0)
    best = lines.groupBy("id").agg(F.min_by(F.struct("n", "text"), F.struct(-evidence, klass, "n")).alias("b"))
    text = F.regexp_replace(F.trim(F.regexp_replace("b.text", r"^\s+|\s+$", "")), r"\p{Cc}", " ")
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)
    return best.select("id", (F.col("b.n") + 1).alias("line"), cut.alias("snippet"))


def search(regions: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """``search.search`` over regions alone: path, tier, score, rank."""
    from .search import Corpus
    from .search import search as whole

    return whole(Corpus(regions), text, limit=limit).select("path", "tier", "score", "rank")


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())
