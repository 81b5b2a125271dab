"""Sessions, audits and request journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import line_fingerprints


def debounce(events: DataFrame, by: list[str], quiet_ms: int = 75, longest_ms: int | None = None) -> DataFrame:
    """Ticks: bursts of events without a pause of ``quiet_ms``; with ``longest_ms`` a burst is cut at that age.

    Columns: by, started, ended, events, tick.  Events without a time are left out.
    """
    q = quiet_ms * 1000
    e = events.where("ts IS NOT NULL").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    # a key's events are cut into buckets of time, so a key with a third of all rows is spread over tasks;
    # a bucket needs only the last event before it and the bursts begun before it, from one row per bucket
    size = max(q * 64, 3_600_000_000)
    e = e.withColumn("bucket", F.floor(F.col("us") / size))
    w = Window.partitionBy(*by, "bucket").orderBy("us")
    e = e.withColumn("inner", (F.col("us") - F.lag("us").over(w) > q).cast("int"))
    per = e.groupBy(*by, "bucket").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.coalesce(F.sum("inner"), F.lit(0)).alias("inside"))
    v = Window.partitionBy(*by).orderBy("bucket")
    per = per.withColumn("opens", F.coalesce((F.col("lo") - F.lag("hi").over(v) > q).cast("int"), F.lit(1)))
    per = per.withColumn("before", F.coalesce(F.sum(F.col("inside") + F.col("opens")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.join(per.select(*by, "bucket", "opens", "before"), [*by, "bucket"])
    run = F.coalesce(F.sum("inner").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    e = e.withColumn("burst", F.col("before") + F.col("opens") + run)
    if longest_ms is None:
        e = e.withColumn("tick", F.lit(0).cast("long"))
    else:
        first = e.groupBy(*by, "burst").agg(F.min("us").alias("first"))
        e = e.join(first, [*by, "burst"]).withColumn("tick", F.floor((F.col("us") - F.col("first")) / (longest_ms * 1000)))
    return e.groupBy(*by, "burst", "tick").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events")).drop("burst")


PLACE = r"[a-z]+(?:/[A-Za-z_]+)+\.[a-z]+:[0-9]+"


def emitted_evidence(texts: DataFrame) -> DataFrame:
    """(id, path, line): the places that texts (id, text) name as path:line, each once."""
    t = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(PLACE), F.lit(0))).alias("place"))
    return t.select("id", F.split_part("place", F.lit(":"), F.lit(1)).alias("path"), F.split_part("place", F.lit(":"), F.lit(2)).cast("long").alias("line")).distinct()


def session_start(texts: DataFrame) -> DataFrame:
    """What a session remembers of each text (id, text) when it starts: its digest and those of its lines."""
    return texts.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("revision"), line_fingerprints(F.col("text")).alias("lines"))


def unexpired(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    return rows.where(F.unix_micros(F.col("ts").cast("timestamp")) + seconds * 1_000_000 > F.unix_micros(now.cast("timestamp")))


def session_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Net changes of a session's files (path, revision, status): renamed where a digest is the only one gone and the
    only one come; modified; coverage_change; deleted or ignored_or_excluded; addition_without_preimage."""
    o = before.select("path", F.struct("revision", "status").alias("o"))
    n = after.select("path", F.struct("revision", "status").alias("n"))
    j = o.join(n, "path", "full")
    gone = j.where(F.col("n").isNull() & F.col("o.revision").isNotNull()).groupBy(F.col("o.revision").alias("revision")).agg(F.count("*").alias("g"), F.min("path").alias("old_path"))
    come = j.where(F.col("o").isNull() & F.col("n.revision").isNotNull()).groupBy(F.col("n.revision").alias("revision")).agg(F.count("*").alias("c"), F.min("path").alias("new_path"))
    ren = gone.join(come, "revision").where("g = 1 AND c = 1").select("old_path", "new_path")
    rest = j.join(ren.select(F.col("old_path").alias("path")), "path", "left_anti").join(ren.select(F.col("new_path").alias("path")), "path", "left_anti")
    kind = (
        F.when(F.col("o").isNull(), "addition_without_preimage")
        .when(F.col("n").isNull() & F.col("o.revision").isNull(), "ignored_or_excluded")
        .when(F.col("n").isNull(), "deleted")
        .when(F.col("o.revision").isNotNull() & F.col("n.revision").isNotNull() & (F.col("o.revision") != F.col("n.revision")), "modified")
        .when(~F.col("o").eqNullSafe(F.col("n")), "coverage_change")
    )
    out = rest.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "kind", F.lit(None).cast("string").alias("old_path"))
    return out.unionByName(ren.select(F.col("new_path").alias("path"), F.lit("renamed").alias("kind"), "old_path"))


def audit(events: DataFrame) -> DataFrame:
    """Per request: whether it was answered, its complete deliveries, tokens and failures.  ``events``: request_id, kind
    (server, delivery, malformed, dropped), complete, tokens.  A request without a delivery is incomplete."""
    e = F.col("kind")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return events.groupBy("request_id").agg(
        n(e == "server").alias("served"), n((e == "delivery") & F.coalesce("complete", F.lit(False))).alias("delivered"), n(e == "delivery").alias("deliveries"),
        F.coalesce(F.sum(F.when((e == "delivery") & F.coalesce("complete", F.lit(False)), F.col("tokens"))), F.lit(0)).alias("tokens"), n(e.isin("malformed", "dropped")).alias("lost"),
    )


def audit_totals(per_request: DataFrame) -> DataFrame:
    a = per_request.agg(F.count("*").alias("requests"), F.sum((F.col("delivered") > 0).cast("long")).alias("complete"), F.sum("tokens").alias("tokens"), F.sum("lost").alias("lost"))
    return a.withColumn("complete_window", (F.col("lost") == 0) & (F.col("complete") == F.col("requests")))


def ledger(changes: DataFrame, emitted: DataFrame) -> DataFrame:
    """Changed spans set against spans emitted before, in the same session, of the same path and revision, that overlap:
    per session changes, and those seen as source or only as metadata."""
    c, m = changes.alias("c"), emitted.alias("m")
    same = (F.col("c.session") == F.col("m.session")) & (F.col("c.path") == F.col("m.path")) & (F.col("c.revision") == F.col("m.revision"))
    overlap = (F.col("c.start") < F.col("m.end")) & (F.col("c.end") > F.col("m.start"))
    hit = c.join(m, same & overlap & (F.col("m.at") <= F.col("c.at")), "left").groupBy("c.session", "c.id").agg(F.max(F.col("m.source").cast("int")).alias("s"))
    return hit.groupBy("session").agg(
        F.count("*").alias("changes"), F.sum(F.coalesce((F.col("s") == 1).cast("long"), F.lit(0))).alias("source"), F.sum(F.coalesce((F.col("s") == 0).cast("long"), F.lit(0))).alias("metadata"),
        F.sum(F.col("s").isNull().cast("long")).alias("unseen"),
    )


def lane_trace(events: DataFrame, most: int = 128) -> DataFrame:
    """Per request and lane: outcome counts, time, and the first ``most`` identities by rank."""
    w = Window.partitionBy("request_id", "lane").orderBy("rank")
    r = events.withColumn("n", F.row_number().over(w))
    return r.groupBy("request_id", "lane").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "identity")))).alias("first"))


READS = ("show", "ctx", "more")


def agent_sessions(records: DataFrame) -> DataFrame:
    """Per session: calls, searches, errors, empty results, repeats, median and 95th percentile time, and searches followed by a read
    within the next three calls.  ``records``: session, seq, verb, hits, elapsed_ms, status, text."""
    w = Window.partitionBy("session").orderBy("seq")
    r = records.withColumn("read_next", F.max(F.col("verb").isin(*READS).cast("int")).over(w.rowsBetween(1, 3)))
    r = r.withColumn("repeat", F.coalesce((F.lag("verb").over(w) == F.col("verb")) & F.lag("text").over(w).eqNullSafe(F.col("text")), F.lit(False)))
    search = F.col("verb") == "search"
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return r.groupBy("session").agg(
        F.count("*").alias("calls"), n(search).alias("searches"), n(F.col("status") == "error").alias("errors"), n(search & (F.col("hits") == 0)).alias("empties"), n(F.col("repeat")).alias("repeats"),
        F.round(F.percentile("elapsed_ms", 0.5), 6).alias("p50_ms"), F.round(F.percentile("elapsed_ms", 0.95), 6).alias("p95_ms"), n(search & (F.col("read_next") == 1)).alias("followed"),
    )


def adoption(records: DataFrame) -> DataFrame:
    """Share of lookups made with the engine per harness: used / (used + escaped)."""
    used, escaped = F.sum((F.col("kind") == "used").cast("long")), F.sum((F.col("kind") == "escaped").cast("long"))
    return records.groupBy("harness").agg(used.alias("used"), escaped.alias("escaped"), F.round(F.when(used + escaped > 0, used / (used + escaped)), 6).alias("adoption"))


def receipt(prepared: int, accepted: int, flushed: bool) -> dict:
    """Delivery receipt: complete only if everything was accepted and flushed."""
    complete = flushed and accepted == prepared
    return {"prepared": prepared, "accepted": accepted, "complete": complete, "failure": None if complete else "flush" if accepted == prepared else "write_zero" if accepted == 0 else "write"}


def journal_segments(records: DataFrame, rotate: int, total: int) -> DataFrame:
    """Segment of each record (ts, id, size) by running size, and whether the newest segments within ``total`` keep it."""
    # running sums by hour, then within the hour
    h = records.withColumn("hour", F.date_trunc("hour", "ts"))
    per = h.groupBy("hour").agg(F.sum("size").alias("sum"))
    per = per.withColumn("before", F.coalesce(F.sum("sum").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("hour", "before")
    w = Window.partitionBy("hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    r = h.join(per, "hour").withColumn("segment", F.floor((F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))) / rotate))
    s = r.groupBy("segment").agg(F.sum("size").alias("bytes"))
    v = Window.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("kept", F.sum("bytes").over(v) <= total)
