"""Symbols and navigation: declarations by name and qualifier, reference sites, outlines, edges by containment, bounded walks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import basename, is_test_path, module_segments
from ..session import write_stage

TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "record")
LOCAL_TIERS = {"module": 1, "variant": 2, "field": 2, "constructor": 2, "variable": 3, "parameter": 3, "import": 3}


def kind_tier(kind: Column) -> Column:
    out = F.lit(0)
    for k, t in LOCAL_TIERS.items():
        out = F.when(kind == k, t).otherwise(out)
    return out


def shared_depth(path: Column, cwd: str) -> Column:
    """Leading directories that a path has in common with a working directory."""
    here = [x for x in cwd.split("/") if x]
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    depth: Column = F.lit(0)
    same: Column = F.lit(True)
    for i, x in enumerate(here):
        same = same & (F.coalesce(F.get(dirs, F.lit(i)), F.lit("")) == x)
        depth = depth + same.cast("int")
    return depth


def rank_declarations(hits: DataFrame, cwd: str = "", limit: int = 10_000) -> DataFrame:
    """The first ``limit`` (a result's size) by (kind tier, test path, directories shared with ``cwd`` descending, path, start, end, id), with their rank."""
    keys = [kind_tier(F.col("kind")), is_test_path(F.col("path")).cast("int"), -shared_depth(F.col("path"), cwd), F.col("path"), F.col("span_start"), F.col("span_end"), F.col("id")]
    return hits.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def symbols(definitions: DataFrame, name: str, cwd: str = "") -> DataFrame:
    """All definitions with the name, ranked.  The name filter comes before anything ordered."""
    return rank_declarations(definitions.where(F.col("name") == name), cwd)


def container_scopes(container: str | None) -> list[list[str]]:
    """Segments of a container: ``impl Trait for Type`` gives type and trait; others are split at ``::``, ``\\``, ``.``, ``/``."""
    if not container:
        return []
    m = re.match(r"impl(?:<[^>]*>)?\s+(?:(.+?)\s+for\s+)?(.+)$", container.strip())
    names = [x for x in (m[2], m[1]) if x] if m else [container]
    return [[re.sub(r"<.*$", "", p).strip() for p in re.split(r"::|[\\./]", n) if p.strip()] for n in names]


def owner_hint(qualifier: list[str]) -> Column:
    """Whether container and path hold all names of a qualifier: necessary for a match, and a cheap test before the exact one."""
    both = F.concat_ws("/", F.coalesce("container", F.lit("")), F.replace("path", F.lit("-"), F.lit("_")))
    hint: Column = F.lit(True)
    for q in qualifier:
        hint = hint & both.contains(q)
    return hint


def no_definition(definitions: DataFrame, keep: Column) -> DataFrame:
    """(name, without_filters): names of which a filter leaves no definition, and how many there are without it."""
    n = definitions.groupBy("name").agg(F.count("*").alias("without_filters"), F.sum(F.coalesce(keep, F.lit(False)).cast("long")).alias("kept"))
    return n.where("kept = 0").select("name", "without_filters")


def definition_lookup(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges (source, target) with the file and name of the definition they point to."""
    d = definitions.select(F.col("id").alias("target"), "file_id", "name").distinct()
    return edges.join(d, "target").select("source", "target", "file_id", "name")


def qualified(definitions: DataFrame, qualifier: list[str], name: str | None) -> DataFrame:
    """``A::b``: definitions ``b`` whose owners - module path and container - end with the qualifier (tier 0) or hold it
    in order (tier 1); only the best tier present is kept.  Without a name, definitions of any name.  A substring test runs before the exact one."""
    owner = F.concat(module_segments(F.col("path")), F.when(F.col("container").isNull(), F.array()).otherwise(F.split("container", r"::|[\\./]")))
    hint = owner_hint(qualifier)
    n = len(qualifier)
    q = F.array(*[F.lit(x) for x in qualifier])
    suffix = (F.size(owner) >= n) & (F.slice(owner, F.greatest(F.size(owner) - n + 1, F.lit(1)), n) == q)
    # position of the next qualifier element, or -1 once one is missing
    reached = F.aggregate(owner, F.lit(0), lambda i, x: F.when((i < n) & (F.get(q, i) == x), i + 1).otherwise(i))
    named = F.lit(True) if name is None else F.col("name") == name
    hit = definitions.where(named & hint).withColumn("tier", F.when(suffix, 0).when(reached == n, 1)).where("tier IS NOT NULL")
    best = hit.agg(F.min("tier").alias("best"))  # one row
    return hit.join(F.broadcast(best)).where("tier = best").drop("best")


def follow_imports(start: DataFrame, imports: DataFrame, hops: int = 4) -> DataFrame:
    """(start, hop, id): the trail of each start through ``imports`` (id, target), at most ``hops`` steps, stopping at a repeat."""
    at = start.select(F.col("id").alias("start"), F.lit(0).alias("hop"), "id", F.array("id").alias("seen"))
    out = at
    for h in range(1, hops + 1):
        nxt = at.join(imports.where("target IS NOT NULL"), "id").where(~F.array_contains("seen", F.col("target")))
        at = nxt.select("start", F.lit(h).alias("hop"), F.col("target").alias("id"), F.concat("seen", F.array("target")).alias("seen"))
        out = out.unionByName(at)
    return out.select("start", "hop", "id")


def reference_tier(role: Column, path: Column) -> Column:
    """3 in a test; 0 a declaration; 2 an import; else 1."""
    return F.when(is_test_path(path), 3).when(role == "declaration", 0).when(role == "import", 2).otherwise(1)


def references(occurrences: DataFrame, name: str | None = None) -> DataFrame:
    """Sites by (tier, path, start, id).  ``occurrences``: id, path, name, role, span_start, target."""
    o = occurrences if name is None else occurrences.where(F.col("name") == name)
    return o.withColumn("tier", reference_tier(F.col("role"), F.col("path")))


def collapse_references(sites: DataFrame) -> DataFrame:
    """One row per (name, path, line, role, target) with how often it repeats and its first site."""
    return sites.groupBy("name", "path", "line", "role", "target").agg(F.count("*").alias("repeats"), F.min("id").alias("id"))


def reference_summary(sites: DataFrame, cap: int = 10000) -> DataFrame:
    return sites.groupBy("name").agg(F.count("*").alias("sites"), F.countDistinct("path").alias("files"), (F.count("*") > cap).alias("truncated"))


FOLDED = ("field", "variant", "variable", "parameter", "import", "constant")


def outline(definitions: DataFrame) -> DataFrame:
    """Outline rows of every file with their place: folded kinds last, then by start and id."""
    d = definitions.where("kind <> 'module'").withColumn("folded", F.col("kind").isin(*FOLDED).cast("int"))
    w = Window.partitionBy("file_id").orderBy("folded", "span_start", "id")
    return d.select("file_id", "id", "name", "kind", "folded", F.row_number().over(w).alias("place"))


def directory_outline(definitions: DataFrame, width: int = 90) -> DataFrame:
    """(file_id, names): types, then functions, then the rest, joined by ', ' up to ``width`` characters, then ' +N'."""
    group = F.when(F.col("kind").isin(*TYPE_KINDS), 0).when(F.col("kind").isin("function", "macro"), 1).otherwise(2)
    top = definitions.where("container IS NULL AND kind <> 'module'").select("file_id", group.alias("g"), "span_start", "id", "name")
    w = Window.partitionBy("file_id").orderBy("g", "span_start", "id")
    run = top.withColumn("n", F.row_number().over(w)).withColumn("reach", F.sum(F.length("name") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2)
    shown = F.col("reach") <= width
    per = run.groupBy("file_id").agg(F.array_sort(F.collect_list(F.when(shown, F.struct("n", "name")))).alias("s"), F.sum((~shown).cast("int")).alias("more"))
    names = F.array_join(F.transform("s", lambda x: x["name"]), ", ")
    return per.select("file_id", F.concat(names, F.when(F.col("more") > 0, F.concat(F.lit(" +"), F.col("more").cast("string"))).otherwise("")).alias("names"))


def map_miss(files: DataFrame, path: str, n: int = 3) -> DataFrame:
    """Nearest paths of one that is not indexed: same name by components shared at the end, else by edit distance of names."""
    want = path.split("/")[::-1]
    parts = F.reverse(F.split("path", "/"))
    shared: Column = F.lit(0)
    same: Column = F.lit(True)
    for i, x in enumerate(want):
        same = same & (F.coalesce(F.get(parts, F.lit(i)), F.lit("")) == x)
        shared = shared + same.cast("int")
    d = files.select("path").distinct().withColumn("shared", shared).withColumn("distance", F.levenshtein(basename(F.col("path")), F.lit(want[0])))
    return d.orderBy(F.desc("shared"), "distance", "path").limit(n)


def context(hits: DataFrame, definitions: DataFrame, edges: DataFrame, cap: int = 100) -> DataFrame:
    """Edges whose source or target definition contains a hit: (hit_id, source, target, kind), at most ``cap`` a hit.

    The containment joins keep their equality on the file.
    """
    h = hits.select(F.col("id").alias("hit_id"), "file_id", F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    around = definitions.join(h.hint("shuffle_hash"), "file_id").where("span_start <= a AND b <= span_end").select("hit_id", F.col("id").alias("node"))
    e = edges.select("source", "target", "kind")
    by_source = around.join(e.withColumnRenamed("source", "node"), "node").select("hit_id", F.col("node").alias("source"), "target", "kind")
    by_target = around.join(e.where("target IS NOT NULL").withColumnRenamed("target", "node"), "node").select("hit_id", "source", F.col("node").alias("target"), "kind")
    both = by_source.unionByName(by_target).distinct()
    w = Window.partitionBy("hit_id").orderBy("kind", "source", "target")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def walk(seeds: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, hops) reached from seeds (id) over edges (source, target): breadth-first, a frontier join and an anti-join a round."""
    e = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    seen = frontier = write_stage(seeds.where("id IS NOT NULL").select("id", F.lit(0).alias("hops")).distinct(), "walk")
    for h in range(1, rounds + 1):
        nxt = frontier.join(e, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = write_stage(nxt.withColumn("hops", F.lit(h)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def resolve_names(occurrences: DataFrame, definitions: DataFrame, cap: int = 64) -> DataFrame:
    """(id, candidates): same-name definitions of the same language family for unresolved occurrences, at most ``cap`` by id.

    Definitions are capped per (family, name) before the join, so a name that a third of
    all definitions bears costs no more than ``cap`` rows a site.  Candidates stay candidates.
    """
    fam = lambda c: F.when(F.col(c).isin("typescript", "javascript"), "script").otherwise(F.col(c))
    w = Window.partitionBy("family", "name").orderBy("id")
    d = definitions.where("language <> 'php'").select(fam("language").alias("family"), "name", "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    names = d.groupBy("family", "name").agg(F.sort_array(F.collect_list("id")).alias("candidates"))
    o = occurrences.where("target IS NULL").select("id", fam("language").alias("family"), "name")
    return o.join(names, ["family", "name"]).select("id", "candidates")
