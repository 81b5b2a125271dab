"""Retrieval quality: recall, span coverage, grades, usage, limits, latency; classes of shell searches."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall(labels: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per task: relevant paths, recall at each k, and whether nothing was found.  ``labels``: task, path; ``hits``: task, path, rank."""
    rel = labels.select("task", "path").distinct()
    best = hits.groupBy("task", "path").agg(F.min("rank").alias("rank"))
    j = rel.join(best, ["task", "path"], "left")
    at = [F.round(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) / F.count("*"), 6).alias(f"recall_{k}") for k in ks]
    out = j.groupBy("task").agg(F.count("*").alias("relevant"), *at)
    return out.withColumn("miss", F.col(f"recall_{max(ks)}") == 0)


def span_coverage(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, covered): whether spans (id, start, end) together cover each label (id, start, end): running reach and gaps."""
    s = spans.join(labels.select("id", F.col("start").alias("a"), F.col("end").alias("b")), "id").where("end > a AND start < b")
    w = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("reach", F.greatest(F.coalesce(F.max("end").over(w), F.col("a")), F.col("a")))
    g = s.groupBy("id").agg(F.max((F.col("start") > F.col("reach")).cast("int")).alias("gap"), F.max("end").alias("reach"))
    return labels.join(g, "id", "left").select("id", F.coalesce((F.col("gap") == 0) & (F.col("reach") >= F.col("end")), F.lit(False)).alias("covered"))


def grade(emitted: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per task, emitted lines (task, path, line, text) that equal the frozen ones, and those that don't."""
    j = emitted.distinct().join(frozen.select("path", "line", F.col("text").alias("want")), ["path", "line"], "left")
    ok = F.coalesce(F.col("text") == F.col("want"), F.lit(False))
    return j.groupBy("task").agg(F.sum(ok.cast("long")).alias("verified"), F.sum((~ok).cast("long")).alias("rejected"))


def usage(events: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Sums per group; a sum with any unknown part is null and the group censored."""
    agg = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns]
    out = events.groupBy(by).agg(*agg)
    hidden: Column = F.lit(False)
    for c in columns:
        hidden = hidden | F.col(c).isNull()
    return out.withColumn("censored", hidden)


def exceeded(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds the names of the limits that a row exceeds, in order."""
    return rows.withColumn("exceeded", F.concat_ws(",", *[F.when(F.col(k) > v, F.lit(k)) for k, v in sorted(limits.items())]))


def latency(rows: DataFrame, by: str, value: str, order: str, warm_up: int = 12) -> DataFrame:
    """Median and 95th percentile per group without its first ``warm_up`` rows."""
    w = Window.partitionBy(by).orderBy(order)
    # only the warm-up rows are ranked; the rest is kept by their last one
    edge = rows.select(by, order).withColumn("n", F.row_number().over(w)).where(F.col("n") <= warm_up).groupBy(by).agg(F.max(order).alias("edge"))
    r = rows.join(edge, by, "left").where(F.col("edge").isNull() | (F.col(order) > F.col("edge")))
    return r.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95"))


_DEFINES = re.compile(r"\b(?:fn|def|class|struct|enum|trait|interface|function|type|proc)\b")


def classify_search(command: str) -> str:
    """Class of a shell search: definition, reference, outline, body, text, or other for what is no search."""
    try:
        words = shlex.split(command)
    except ValueError:
        words = command.split()
    if not words or words[0].rsplit("/", 1)[-1] not in ("grep", "rg", "ag", "ack", "egrep", "fgrep", "git"):
        return "other"
    if words[0] == "git" and words[1:2] != ["grep"]:
        return "other"
    flags = [w for w in words[1:] if w.startswith("-")]
    pattern = next((w for w in words[1:] if not w.startswith("-") and w != "grep"), "")
    if any(re.match(r"-[a-zA-Z]*[ABC]\d*$", f) for f in flags):
        return "body"
    if "|" in pattern and _DEFINES.search(pattern) and len(_DEFINES.findall(pattern)) > 1:
        return "outline"
    if _DEFINES.search(pattern):
        return "definition"
    if "-w" in flags or re.fullmatch(r"(?:\\b)?[A-Za-z_]\w*(?:\\b|\\?\()?", pattern):
        return "reference"
    return "text"
