"""Vector cache: keys, normal form, validation, lookup, upsert with eviction, missing work, batches, fair turns."""

from __future__ import annotations

import hashlib
import threading
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import numbered
from .lanes import norm


def content_key(text: str, manifest: str, model: str, version: int, dims: int, normal: str = "l2") -> str:
    """Digest of labelled, length-prefixed fields, so no two field lists share a key."""
    h = hashlib.sha256()
    for name, v in (("manifest", manifest), ("model", model), ("version", str(version)), ("dims", str(dims)), ("norm", normal), ("text", text)):
        raw = v.encode()
        h.update(name.encode() + len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalise(vectors: DataFrame, dims: int) -> DataFrame:
    """Unit vectors in double precision; wrong length, non-finite and zero vectors are left out."""
    ok = (F.size("vector") == dims) & finite(F.col("vector")) & (norm(F.col("vector")) > 0)
    return vectors.where(ok).withColumn("n", norm(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x.cast("double") / F.col("n"))).drop("n")


def validity(vectors: DataFrame, dims: int, tolerance: float = 0.001) -> DataFrame:
    """Adds state: ok, or missing, length, non_finite, norm."""
    v = F.col("vector")
    state = F.when(v.isNull(), "missing").when(F.size(v) != dims, "length").when(~finite(v), "non_finite").when(F.abs(norm(v) - 1) > tolerance, "norm").otherwise("ok")
    return vectors.withColumn("state", state)


def latest(cache: DataFrame) -> DataFrame:
    """The row of each key that was touched last; ties are copies."""
    cols = [c for c in cache.columns if c not in ("key", "touched")]
    best = cache.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*cols), F.coalesce("touched", F.lit(-1))).alias("r"), F.max("touched").alias("touched"))
    return best.select("key", "r.*", "touched")


def lookup(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(cache, "key", "left")


def put(cache: DataFrame, entries: DataFrame, capacity: int) -> DataFrame:
    """Upsert by key - last write wins - keeping the ``capacity`` most recently written (ties by key)."""
    cols = [c for c in cache.columns if c != "key"]
    merged = cache.unionByName(entries.select(*cache.columns)).where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*cols), F.coalesce("touched", F.lit(-1))).alias("r")).select("key", "r.*")
    return merged.orderBy(F.desc("touched"), "key").limit(capacity)


def missing(regions: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys of one generation's regions that the cache lacks, once each."""
    return regions.select("key").where("key IS NOT NULL").distinct().join(cache.select("key"), "key", "left_anti")


def plan_batches(lengths: list[int], most: int = 8, tokens: int = 8192) -> list[tuple[int, int]]:
    """Greedy ranges of at most ``most`` inputs with count x longest within ``tokens``; one longer input stands alone."""
    out, a, longest = [], 0, 0
    for i, n in enumerate(lengths):
        longest2 = max(longest, n)
        if i > a and (i - a + 1 > most or (i - a + 1) * longest2 > tokens):
            out.append((a, i))
            a, longest2 = i, n
        longest = longest2
    if a < len(lengths):
        out.append((a, len(lengths)))
    return out


def batches(inputs: DataFrame, by: str, most: int = 8, tokens: int = 8192, block: int = 65536) -> DataFrame:
    """(by, nth, tokens) -> (by, nth, batch): the same greedy fold, per group in order of nth.

    A group is folded in blocks of ``block`` successive numbers, so no task gets a group without bound: a batch never
    goes over the end of a block, and batches are numbered through by the counts of the blocks before.
    """

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        batch = np.zeros(rows.num_rows, np.int64)
        for k, (a, b) in enumerate(plan_batches(rows.column("tokens").to_pylist(), most, tokens)):
            batch[a:b] = k
        return pa.table({by: rows.column(by), "block": rows.column("block"), "nth": rows.column("nth"), "inner": pa.array(batch)})

    cut = inputs.select(by, F.floor(F.col("nth") / block).alias("block"), F.col("nth").cast("long").alias("nth"), "tokens")
    kind = cut.schema[by].dataType.simpleString()
    rows = cut.groupBy(by, "block").applyInArrow(fold, f"{by} {kind}, block long, nth long, inner long")
    per = rows.groupBy(by, "block").agg((F.max("inner") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(per.select(by, "block", before.alias("before")), [by, "block"]).select(by, "nth", (F.col("before") + F.col("inner")).cast("int").alias("batch"))


def fair_turns(queue: DataFrame, query_turns: int = 3) -> DataFrame:
    """Order of service: roots take turns; after ``query_turns`` queries one background item.  ``queue``: root, arrived, background.

    An item's place is its number in the order of turn and root; turns and places are numbered without gathering a root or a turn in one task.
    """
    r = numbered(queue, ["root", "background"], ["arrived"], "nth")
    r = numbered(r, ["background"], ["nth", "root"], "place")
    slot = F.when(F.col("background"), F.col("place") * (query_turns + 1)).otherwise(F.col("place") + F.floor((F.col("place") - 1) / query_turns))
    return r.withColumn("slot", slot.cast("long"))


class Admission:
    """Bounded work in flight: at most so many batches, inputs a batch, and bytes in total."""

    def __init__(self, most_batches: int = 64, most_inputs: int = 8, most_bytes: int = 8 << 20):
        self.limits, self.batches, self.bytes, self.lock = (most_batches, most_inputs, most_bytes), 0, 0, threading.Lock()

    def try_admit(self, inputs: int, size: int) -> bool:
        with self.lock:
            if inputs > self.limits[1] or self.batches >= self.limits[0] or self.bytes + size > self.limits[2]:
                return False
            self.batches, self.bytes = self.batches + 1, self.bytes + size
            return True

    def release(self, size: int) -> None:
        with self.lock:
            self.batches, self.bytes = self.batches - 1, self.bytes - size


def check_rerank(query: str, documents: list[str], most: int = 32, size: int = 4096) -> None:
    if len(documents) > most:
        raise ValueError(f"at most {most} documents")
    if any(len(x.encode()) > size for x in documents) or not query.strip():
        raise ValueError("a document is too long or the query is empty")


class BoundedQueue:
    """Drops and counts what doesn't fit."""

    def __init__(self, most: int = 32):
        self.most, self.items, self.dropped = most, deque(), 0

    def record(self, item: object) -> bool:
        if len(self.items) >= self.most:
            self.dropped += 1
            return False
        self.items.append(item)
        return True


def offer(arrivals: DataFrame, by: list[str], order: list[str], most: int = 32) -> DataFrame:
    """What bounded queues, one for each of ``by``, take and drop of the arrivals in their order: (by, taken, dropped)."""
    n = arrivals.groupBy(*by).agg(F.count("*").alias("n"))
    return n.select(*by, F.least("n", F.lit(most)).alias("taken"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))


def admit(requests: DataFrame, by: str, most_batches: int = 64, most_inputs: int = 8, most_bytes: int = 8 << 20) -> DataFrame:
    """(by, nth, inputs, size) -> (by, admitted, refused): each group's requests offered in order to an ``Admission`` that releases none."""

    def run(rows: pa.Table) -> pa.Table:
        rows, gate = rows.sort_by("nth"), Admission(most_batches, most_inputs, most_bytes)
        ok = sum(gate.try_admit(n, size) for n, size in zip(rows.column("inputs").to_pylist(), rows.column("size").to_pylist()))
        return pa.table({by: rows.column(by).slice(0, 1), "admitted": pa.array([ok], pa.int64()), "refused": pa.array([rows.num_rows - ok], pa.int64())})

    kind = requests.schema[by].dataType.simpleString()
    return requests.select(by, "nth", "inputs", "size").groupBy(by).applyInArrow(run, f"{by} {kind}, admitted long, refused long")
