"""The search pipeline: query text, filters, lanes in their order, fusion, semantic lane, reranking, de-duplication, snippets.

Every lane gives at most ``lanes.LANE_FILES`` paths before it is joined with anything, so fusion works on a few thousand rows
whatever the size of the corpus.  Filters are bound once and hold in every lane before it is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters, fusion, navigation
from . import lanes as L
from .postings import Postings, lane

SNIPPET_HITS = 200
MAX_HITS = 10_000
HIT = ("id", "kind", "name", "span_start", "span_end")


@dataclass
class Corpus:
    """What is searched; all but ``regions`` may be missing.

    ``regions``: id, path, name, expanded, body and, where there are any, kind, language, file_id, span_start, span_end;
    ``definitions``: id, path, name, kind, container, language, span_start, span_end; ``occurrences``: path, name, role, span_start, span_end, language;
    ``vectors``: id (of a region), path, vector; ``postings``: the index of the regions, else it is built for the query.
    """

    regions: DataFrame
    files: DataFrame | None = None
    definitions: DataFrame | None = None
    occurrences: DataFrame | None = None
    vectors: DataFrame | None = None
    postings: Postings | None = None


def _where(paths: DataFrame, q: filters.Query) -> Callable[[DataFrame], DataFrame]:
    """The query's filters, bound to the paths once, as a step that keeps what they let through."""
    bound = filters.bind(paths, q)

    def keep(df: DataFrame) -> DataFrame:
        return df if bound is None else df.where(bound(df.columns))

    return keep


def _hits(df: DataFrame, no: int, provenance: str) -> DataFrame:
    """(lane_no, provenance, path, rank, score, hit) of a lane that has path and rank."""
    kinds = {"id": "long", "kind": "string", "name": "string", "span_start": "long", "span_end": "long"}
    hit = F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    score = F.col("score").cast("double") if "score" in df.columns else F.lit(None).cast("double")
    return df.select(F.lit(no).alias("lane_no"), F.lit(provenance).alias("provenance"), "path", "rank", score.alias("score"), hit.alias("hit"))


def _numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def exact_lane(definitions: DataFrame, name: str) -> DataFrame:
    return _numbered(L.exact(definitions, name), "path", "span_start", "span_end", "id")


def qualified_lane(definitions: DataFrame, qualifier: list[str], name: str) -> DataFrame:
    """Definitions that a qualified name means, the first of each path."""
    hit = navigation.qualified(definitions, qualifier, name)
    first = hit.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("span_start", "span_end", "id"))).where("n = 1").drop("n")
    return navigation.rank_declarations(first, limit=L.LANE_FILES)


def occurrence_lane(regions: DataFrame, occurrences: DataFrame, name: str, qualifier: str | None) -> DataFrame:
    """Per path the smallest region around its best occurrence of the name; paths by uses.  With a qualifier only paths that hold that too."""
    o = occurrences.where(F.col("name") == name)
    if qualifier is not None:
        o = o.join(occurrences.where(F.col("name") == qualifier).select("path").distinct(), "path", "left_semi")
    role = F.when(F.col("role") == "declaration", 0).when(F.col("role").isin("import", "import_path"), 2).otherwise(1)
    sites = o.select("path", F.col("span_start").alias("a"), F.col("span_end").alias("b"), role.alias("tier"))
    spans = regions.select("path", "id", "kind", F.col("name").alias("region_name"), "span_start", "span_end")
    # a region is in reach only of a path that has the name: the sites are few and the hash table is built of them
    inside = spans.join(sites.hint("shuffle_hash"), "path").where("span_start <= a AND b <= span_end")
    best = inside.groupBy("path").agg(F.min(F.struct("tier", "a", "b", F.expr("span_end - span_start").alias("width"), "id", "kind", "region_name", "span_start", "span_end")).alias("r"), F.count_distinct("a", "b").alias("score"))
    one = best.select("path", "r.id", "r.kind", F.col("r.region_name").alias("name"), "r.span_start", "r.span_end", "score").orderBy(F.desc("score"), "path").limit(L.LANE_FILES)
    return _numbered(one, F.desc("score"), "path")


def policy(hits: DataFrame, q: filters.Query, identifier: bool) -> DataFrame:
    """Adds weight, prior and the tiers of evidence to the hits of the lanes."""
    terms = L.name_terms(q.text)
    local = F.coalesce(F.col("hit.kind").isin(*fusion.LOCAL_KINDS), F.lit(False))
    exact_name = F.coalesce(L.filename_score(F.col("path"), terms) == 3, F.lit(False)) & F.lit(bool(terms))
    p = F.col("provenance")
    weight = F.when(F.lit(identifier) & (p == "exact_identifier") & ~local, 3.0).when(p.isin("phrase", "filename_exact"), 2.0).when(p == "filename_partial", 0.5).otherwise(1.0)
    if identifier:
        tier = F.when(exact_name, 0).when((p == "exact_identifier") & ~local, 1).when(p.isin("exact_identifier", "identifier_occurrence"), 2).otherwise(3)
    else:
        tier = F.lit(0)
    # named, defined and phrases alike before uses, and those before the rest: which hit stands for a path, and the order of reranking
    shown = F.when(F.lit(identifier) & exact_name | (p == "phrase"), 0).when(F.lit(not identifier), 2)
    shown = shown.when((p == "exact_identifier") & ~local, 0).when(p.isin("exact_identifier", "identifier_occurrence"), 1).otherwise(2)
    prior = fusion.path_prior(F.col("path"), terms, q.includes, identifier, q.kind, q.language)
    return hits.withColumns({"weight": weight, "prior": prior, "tier": tier, "shown": shown})


def fuse(hits: DataFrame) -> DataFrame:
    """Hits with weight, prior and tiers -> one row per path: tier, score, the hit that stands for it, its provenance; ranked."""
    term = F.col("weight") * F.col("prior") / (fusion.RRF_K + F.col("rank"))
    by = hits.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("lane_no", term.alias("t")))).alias("parts"), F.min("tier").alias("tier"), F.min(F.struct("shown", "lane_no", "rank", "provenance", "hit")).alias("best")
    )
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["t"])
    out = by.select("path", "tier", F.round(total, 9).alias("score"), "best.shown", "best.provenance", "best.hit")
    return _numbered(out, "tier", F.desc("score"), "path")


def lexical(corpus: Corpus, q: filters.Query, keep: Callable[[DataFrame], DataFrame], where: Column | None) -> DataFrame | None:
    """The lanes of a free text in their order: exact, qualified, occurrence, phrase, all terms, any term, file names."""
    c = L.concept(q.text)
    found: list[DataFrame] = []
    add = lambda df, provenance: found.append(_hits(df, len(found), provenance))
    names = corpus.files if corpus.files is not None else corpus.regions
    if corpus.definitions is not None and q.text:
        add(exact_lane(keep(corpus.definitions), q.text), "exact_identifier")
    if c["name"] is not None:
        if c["qualifier"] is not None and corpus.definitions is not None:
            add(qualified_lane(keep(corpus.definitions), c["segments"][:-1], c["name"]), "exact_identifier")
        if corpus.occurrences is not None:
            add(occurrence_lane(keep(corpus.regions), corpus.occurrences, c["name"], c["qualifier"]), "identifier_occurrence")
    if c["any"] or c["phrase"]:
        index = corpus.postings or Postings.build(corpus.regions)
        groups = [L.query_terms(t) for t in L.word_terms(q.text)] if c["any"] else []
        best = index.paths([g for g in dict.fromkeys(map(tuple, groups)) if g], c["phrase"], where)
        for provenance, of in (("phrase", bool(c["phrase"])), ("all", bool(c["all"])), ("any", bool(c["any"]))):
            if of:
                add(_numbered(lane(best, provenance, L.LANE_FILES), F.desc("score"), "path"), {"all": "all_terms", "any": "lexical"}.get(provenance, provenance))
    if (c["any"] or not q.text) and q.kind in (None, "file"):
        no = len(found)
        f = L.filename(keep(names.select("path", *[x for x in ("language",) if x in names.columns])), L.name_terms(q.text))
        h = _hits(f, no, "filename")
        found.append(h.withColumn("provenance", F.when(F.col("score") == 3, "filename_exact").when(F.col("score") == 2, "filename_tokens").otherwise("filename_partial")))
    out = None
    for h in found:
        out = h if out is None else out.unionByName(h)
    return out


def search(
    corpus: Corpus, text: str, vector: list[float] | None = None, scorer: Callable[[pd.Series], pd.Series] | Column | None = None, limit: int = MAX_HITS, snippets: bool = False, window: int = 32,
) -> DataFrame:
    """(rank, path, tier, score, provenance, id, kind, name, span_start, span_end[, line, snippet]) of a query.

    ``text``: words and ``file:``, ``-file:``, ``lang:``, ``kind:`` filters; ``sym:`` looks for a definition, ``re:`` for a pattern.
    ``vector``: the query's vector, fused as a further lane unless the text is a literal; ``scorer``: a column, or a vectorised
    function of ``body``, that reorders the first ``window`` hits.  Snippets are given to the first 200 hits.
    An empty corpus, a filter that nothing passes and a text without terms give no rows; ties end by path.
    """
    q = filters.parse_query(text)
    names = corpus.files if corpus.files is not None else corpus.regions
    bound = filters.bind(names, q)
    keep = _where(names, q)
    if q.regex:
        return regex_search(corpus, q, keep, limit)
    if q.exact:
        if corpus.definitions is None:
            raise ValueError("a corpus without definitions has no symbols")
        ranked = navigation.symbols(keep(corpus.definitions), q.text)
        out = ranked.select("rank", "path", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("score"), F.lit("exact_identifier").alias("provenance"), *HIT)
    else:
        identifier = L.concept(q.text)["name"] is not None
        columns = ("path", "kind", "language")
        found = lexical(corpus, q, keep, bound(columns) if bound is not None else None)
        hits = policy(found, q, identifier)
        ranked = fuse(hits)
        if vector is not None and corpus.vectors is not None and q.text and not L.concept(q.text)["literal"]:
            sem = _hits(L.semantic(keep(corpus.vectors), vector), 1, "semantic")
            sem = policy(sem, q, identifier).withColumn("weight", F.lit(1.0))
            again = ranked.select(F.lit(0).alias("lane_no"), "provenance", "path", "rank", "score", "hit", F.lit(1.0).alias("weight"), F.lit(1.0).alias("prior"), "tier", "shown")
            ranked = fuse(again.unionByName(sem))
        if scorer is not None and q.text:
            body = corpus.regions.select(F.col("id").alias("region"), "body")
            head = ranked.where(F.col("rank") <= window)
            # the window's rows are at most ``window``
            head = body.join(F.broadcast(head), F.col("region") == F.col("hit.id"), "right").drop("region")
            again = fusion.rerank(head.withColumn("fused_tier", F.col("tier")).withColumn("tier", F.col("shown")), scorer, window)
            again = again.withColumn("rank", F.col("final_rank")).withColumn("tier", F.col("fused_tier"))
            ranked = again.select(ranked.columns).unionByName(ranked.where(F.col("rank") > window))
        out = ranked.select("rank", "path", "tier", "score", "provenance", *[F.col(f"hit.{c}").alias(c) for c in HIT])
    out = out.where(F.col("rank") <= min(limit, MAX_HITS))
    return attach_snippets(out, corpus.regions, L.snippet_terms(q.text)) if snippets else out


def attach_snippets(ranked: DataFrame, regions: DataFrame, terms: list[str]) -> DataFrame:
    """The best line of each of the first 200 hits' regions."""
    some = ranked.where(F.col("rank") <= SNIPPET_HITS).select("id", F.col("name").alias("hit_name")).where("id IS NOT NULL").distinct()
    # at most SNIPPET_HITS rows
    bodies = regions.select("id", "body").join(F.broadcast(some), "id")
    lines = fusion.snippets(bodies.withColumnRenamed("hit_name", "name"), terms)
    return ranked.join(F.broadcast(lines), "id", "left")


def regex_search(corpus: Corpus, q: filters.Query, keep: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """One hit per line on which a match of the pattern begins; with ``kind:``, those within a definition of that kind."""
    texts = keep(corpus.regions.drop("kind") if "kind" in corpus.regions.columns else corpus.regions)
    found = L.regex_matches(texts, q.text)
    at = texts.select("id", "path", *[(F.col(c) if c in texts.columns else F.lit(0).cast("long")).alias(c) for c in ("span_start",)])
    hits = found.join(at, "id").select("path", F.col("id"), (F.col("span_start") + F.col("start")).alias("span_start"), (F.col("span_start") + F.col("end")).alias("span_end"), F.substring("text", 1, 96).alias("name"))
    if q.kind is not None:
        if corpus.definitions is None:
            raise ValueError("a corpus without definitions has no kinds")
        d = corpus.definitions.where(F.col("kind") == q.kind).select("path", F.col("span_start").alias("a"), F.col("span_end").alias("b")).distinct()
        hits = hits.join(d, "path").where("a <= span_start AND span_end <= b").select(hits.columns).distinct()
    # regions of one path may overlap
    hits = hits.groupBy("path", "span_start", "span_end").agg(F.min("id").alias("id"), F.min("name").alias("name")).orderBy("path", "span_start", "span_end").limit(min(limit, MAX_HITS))
    out = _numbered(hits, "path", "span_start", "span_end")
    return out.select("rank", "path", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("score"), F.lit("live_regex").alias("provenance"), "id", F.lit(q.kind or "region").alias("kind"), "name", "span_start", "span_end")
