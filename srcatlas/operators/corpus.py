"""Corpus operators: current rows, exclusion ladder, content identity, fingerprints, regions, change of generation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MAX_FILE = 2 << 20
REGION = 4096


def current(files: DataFrame) -> DataFrame:
    """Row per id with the highest generation (null lowest; ties are copies); aggregated map-side first."""
    cols = [c for c in files.columns if c != "id"]
    order = F.struct(F.coalesce("generation", F.lit(-1)), F.coalesce("revision", F.lit("")))
    return files.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("id", "r.*")


def read_status(data: DataFrame) -> DataFrame:
    """Exclusion ladder on (path, bytes, length): adds status; excluded rows keep their path and lose their body.

    null length -> metadata_error; over 2 MiB -> resource_excluded; null body -> read_error;
    a NUL byte -> binary_excluded; else read.
    """
    nul = F.hex("bytes").rlike("^(..)*00")
    status = (
        F.when(F.col("length").isNull(), "metadata_error").when(F.col("length") > MAX_FILE, "resource_excluded").when(F.col("bytes").isNull(), "read_error").when(nul, "binary_excluded").otherwise("read")
    )
    out = data.withColumn("status", status)
    return out.withColumn("bytes", F.when(F.col("status") == "read", F.col("bytes")))


def content_dedup(bodies: DataFrame) -> DataFrame:
    """(revision, bytes, copies): one row per distinct non-null body, by its digest, and how many rows had it."""
    return bodies.where("bytes IS NOT NULL").select(F.sha2("bytes", 256).alias("revision"), "bytes").groupBy("revision").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))


def scan_fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of the (path, status, bytes, revision) of all current files, per group: equal digests mean nothing to publish.

    Each group's rows are reduced to digests of 256 hash buckets before they are put
    in order, so no group's rows are gathered in one place.
    """
    by = by or []
    row = F.sha2(F.concat_ws("\x1f", F.coalesce("path", F.lit("")), F.coalesce("status", F.lit("")), F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce("revision", F.lit(""))), 256)
    part = files.select(*by, row.alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    # the sum of 60-bit pieces of digests doesn't depend on order and is reduced map-side
    piece = lambda i: F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    buckets = part.groupBy(*by, "bucket").agg(F.count("*").alias("n"), piece(1).alias("a"), piece(13).alias("b"))
    text = F.concat_ws(":", "bucket", F.col("n").cast("string"), "a", "b")
    return buckets.groupBy(*by).agg(F.sum("n").alias("files"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(text))), 256).alias("fingerprint"))


def cached_facts(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (revision, grammar, version) against a cache of facts; a cached ``cancelled`` is a miss."""
    key = ["revision", "grammar", "version"]
    good = cache.where("status <> 'cancelled' OR status IS NULL")
    return wanted.join(good, key), wanted.join(good.select(key), key, "left_anti")


def regions_of(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """(start, end, owner) regions of at most ``REGION`` bytes that cover a body.

    ``spans``: (start, end, definition).  The largest definitions that fit are kept whole; the rest is cut
    after its last line end in reach, else before a character; the owner is the smallest definition that contains the region.
    """
    n = len(data)
    spans = sorted({(a, b, i) for a, b, i in spans if 0 <= a < b <= n}, key=lambda s: (s[0], -s[1]))
    whole, reach = [], 0
    for a, b, _ in spans:
        if b - a <= REGION and a >= reach:
            whole.append((a, b))
            reach = b
    out: list[tuple[int, int]] = []

    def fill(a: int, b: int) -> None:
        while b - a > REGION:
            cut = data.rfind(b"\n", a, a + REGION) + 1
            if cut <= a:
                cut = a + REGION
                while cut > a + 1 and cut < n and data[cut] & 0xC0 == 0x80 and a + REGION - cut < 3:
                    cut -= 1
            out.append((a, cut))
            a = cut
        if b > a:
            out.append((a, b))

    at = 0
    for a, b in whole:
        fill(at, a)
        out.append((a, b))
        at = b
    fill(at, n)
    result: list[tuple[int, int, int | None]] = []
    for a, b in out:
        best = None
        for s, e, i in spans:
            if s > a:
                break
            if e >= b and (best is None or (e - s, i) < best[:2]):
                best = (e - s, i)
        result.append((a, b, best[1] if best else None))
    return result


def region_partition(bodies: DataFrame, definitions: DataFrame) -> DataFrame:
    """(revision, span_start, span_end, definition) regions of every body; ``definitions``: (id, revision, span_start, span_end)."""
    spans = definitions.where("span_start IS NOT NULL AND span_end IS NOT NULL").select("revision", F.struct("span_start", "span_end", "id").alias("s")).distinct()
    grouped = spans.groupBy("revision").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    joined = bodies.select("revision", "bytes").where("bytes IS NOT NULL").join(grouped.hint("shuffle_hash"), "revision", "left")
    schema = T.StructType([T.StructField("revision", T.StringType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("definition", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for rev, body, sp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for a, b, i in regions_of(body.as_py(), [(x["span_start"], x["span_end"], x["id"]) for x in sp or []]):
                    for col, x in zip(out, (rev, a, b, i)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]], names=schema.names)

    return joined.select("revision", "bytes", "spans").mapInArrow(run, schema)


def region_faults(regions: DataFrame, bodies: DataFrame) -> DataFrame:
    """Regions that break the rules: out of order, too long, outside their body, or overlapping their predecessor in the file."""
    w = Window.partitionBy("file_id").orderBy("span_start", "span_end", "region_id")
    size = bodies.select("revision", F.length("bytes").alias("size"))
    r = regions.withColumn("before", F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(size, "revision", "left")
    fault = (
        F.when(F.col("span_end") <= F.col("span_start"), "empty")
        .when(F.col("span_end") - F.col("span_start") > REGION, "too_long")
        .when(F.col("span_end") > F.col("size"), "outside")
        .when(F.col("span_start") < F.col("before"), "overlap")
    )
    return r.withColumn("fault", fault).where("fault IS NOT NULL").select("region_id", "file_id", "fault")


def insert_facts(facts: DataFrame, cap: int = 64) -> tuple[DataFrame, DataFrame]:
    """File-local facts to global rows.  ``facts``: (file_id, definitions array<struct<name,kind,start,end>>,
    edges array<struct<source int, target int, kind>>).  Returns (definitions with ``id``, edges with global ids);
    edges without a source are dropped; at most ``cap`` edges per source are kept, in order."""
    d = facts.select("file_id", F.posexplode("definitions").alias("local", "d")).select("file_id", "local", "d.*")
    d = d.withColumn("id", F.col("file_id") * 100000 + F.col("local"))
    e = facts.select("file_id", F.posexplode("edges").alias("nth", "e")).select("file_id", "nth", "e.*").where("source IS NOT NULL")
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "source").orderBy("nth"))).where(F.col("rank") <= cap)
    gid = lambda c: F.when(F.col(c).isNotNull(), F.col("file_id") * 100000 + F.col(c))
    return d.select("id", "file_id", "name", "kind", "start", "end"), e.select("file_id", gid("source").alias("source"), gid("target").alias("target"), "kind")


def doctor(files: DataFrame, contents: DataFrame, definitions: DataFrame, regions: DataFrame) -> DataFrame:
    """(probe, rows): orphans between the relations, both ways; keys alone are compared."""
    used = files.where("revision IS NOT NULL").select("revision").distinct()
    probes = {
        "files_without_body": used.join(contents.select("revision"), "revision", "left_anti"),
        "bodies_without_file": contents.select("revision").join(used, "revision", "left_anti"),
        "definitions_without_file": definitions.select("id", F.col("file_id").alias("fid")).distinct().join(files.select(F.col("id").alias("fid")).distinct(), "fid", "left_anti"),
        "regions_without_definition": regions.where("definition IS NOT NULL").select(F.col("definition").alias("id")).distinct().join(definitions.select("id").distinct(), "id", "left_anti"),
    }
    out = None
    for name, p in probes.items():
        one = p.agg(F.count("*").alias("rows")).select(F.lit(name).alias("probe"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sweep(entries: DataFrame, live: DataFrame, now: float, grace_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) cache folders (name, touched seconds): those no live root names and that nobody touched within the grace go."""
    named = live.select("name").distinct().withColumn("used", F.lit(True))
    j = entries.join(named, "name", "left")
    keep = F.coalesce("used", F.lit(False)) | (F.col("touched") > now - grace_seconds) | F.col("touched").isNull()
    return j.where(keep).drop("used"), j.where(~keep).drop("used")


def within_budget(rows: DataFrame, most_rows: int, most_bytes: int, size: str) -> DataFrame:
    """``rows`` if they stay within a budget of rows and bytes (sum of ``size``), else an error; the check is one aggregate."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > most_rows or total > most_bytes:
        raise RuntimeError(f"staging budget exceeded: {n} rows, {total} bytes")
    return rows
