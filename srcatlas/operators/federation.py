"""Several members at once: scope, widening, round-robin merge, coverage, owners of results, fallback to a parent index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scope(words: list[str], members: list[str], home: str) -> tuple[list[str], list[str]]:
    """(members to search, remaining words): ``in:NAME``, ``ws:home``, ``ws:all``; default home; conflicting selectors are an error."""
    chosen: set[str] = set()
    mode, rest = None, []
    for w in words:
        if w.startswith("in:"):
            if w[3:] not in members:
                raise ValueError(f"no member {w[3:]!r}")
            chosen.add(w[3:])
        elif w in ("ws:home", "ws:all"):
            if mode and mode != w:
                raise ValueError("conflicting scopes")
            mode = w
        else:
            rest.append(w)
    if chosen and mode:
        raise ValueError("conflicting scopes")
    return sorted(chosen) or (sorted(members) if mode == "ws:all" else [home]), rest


def widen(hits: DataFrame, home: str) -> DataFrame:
    """Home's hits if it has any, else those of all members."""
    mine = hits.where(F.col("member") == home)
    return hits if mine.limit(1).isEmpty() else mine


def merge(hits: DataFrame, home: str, quota: int = 1000) -> DataFrame:
    """Round-robin by rank within members, home first and then by name, at most ``quota`` a member; adds place.

    ``hits``: member, rank (1, 2, ... within the member).
    """
    order = F.struct((F.col("member") != home).alias("other"), F.col("member").alias("name"))
    kept = hits.where(F.col("rank") <= quota)
    # place = hits of smaller ranks of all members + members before this one at this rank: from one small table
    sizes = kept.groupBy("member").agg(F.max("rank").alias("size")).withColumn("o", order)
    per_rank = kept.groupBy("rank").agg(F.count("*").alias("n"))
    before = per_rank.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("rank", "before")
    w = Window.partitionBy("rank").orderBy("o.other", "o.name")
    return kept.join(sizes.select("member", "o"), "member").join(before, "rank").withColumn("place", F.col("before") + F.row_number().over(w)).drop("o", "before")


def coverage(hits: DataFrame, reported: DataFrame, quota: int = 1000) -> DataFrame:
    """Per member: state, hits kept and cut, whether its last scan was partial."""
    h = hits.groupBy("member").agg(F.count("*").alias("hits"))
    last = reported.where("member IS NOT NULL").groupBy("member").agg(F.max_by(F.struct("excluded_files", "walk_failures", "truncated_files"), F.struct("generation", "captured_at")).alias("c"))
    r = last.join(h, "member", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    partial = (F.coalesce("c.excluded_files", F.lit(0)) + F.coalesce("c.walk_failures", F.lit(0)) + F.coalesce("c.truncated_files", F.lit(0))) > 0
    return r.select(
        "member", F.when(F.col("hits") > 0, "answered").otherwise("empty").alias("state"), F.least("hits", F.lit(quota)).alias("retained"), (F.col("hits") > quota).alias("truncated"), partial.alias("partial")
    )


def parent_fallback(parent_hits: DataFrame, own_files: DataFrame) -> DataFrame:
    """Hits of a parent's index as seen from a worktree: verified, differs or absent, by digest of the same path."""
    own = own_files.select("path", F.col("revision").alias("own_revision"))
    j = parent_hits.join(own, "path", "left")
    state = F.when(F.col("own_revision").isNull(), "absent").when(F.col("own_revision") == F.col("revision"), "verified").otherwise("differs")
    return j.withColumn("state", state).drop("own_revision")


def replace_changed(parent: DataFrame, own: DataFrame, changed: DataFrame) -> DataFrame:
    """Parent's definitions without those of changed paths, and the worktree's own for these."""
    return parent.join(changed.select("path").distinct(), "path", "left_anti").unionByName(own.join(changed.select("path").distinct(), "path", "left_semi"))
