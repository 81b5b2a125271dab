"""Problem 3: the most similar vectors for every vector.

An inverted index of balanced posting lists of about ``list_size`` vectors.  A few
top centres are fitted on a bounded sample; the lists' centroids are fitted
within the tops, in tasks, on ``per_list`` vectors a list chosen by hash, so their number
grows with the data.  A vector is stored in every list whose squared distance is within a ratio of that of its
nearest one, up to a number of replicas, so vectors near a boundary stand in several
lists.  Centroids are searched through an in-memory graph of their
neighbours, at every size: a beam of fixed width a row, ``TOGETHER`` rows near each other at once, so that lists are looked at
in matrix products; at most ``GRAPH`` for each list that stands in a beam of theirs, whatever the number of lists.
Lists are compared as matrix products within a list; a list longer than ``block`` is worked in pairs of blocks.

Exact copies of a vector are one entry of the index (their least key), so a group
of copies costs what one vector costs.  All vectors are indexed.  What is sent to the tasks is at most
``max_lists`` centroids (256 bytes each) with ``GRAPH`` neighbours each: under 100 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage

DIMS = 64
GRAPH = 24
#: least width of the beam, entry points of a search, lists of an entry point
BEAM, ENTRIES, ENTRY = 48, 6, 16
#: rows that are searched together, and rows gathered of which those near each other are
TOGETHER, GATHERED = 128, 1 << 15


def usable(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(key, vector): current row per key (highest ``touched``; ties are copies) if its vector has exactly ``dims`` finite numbers, not all zero."""
    now = vectors.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("vector"), F.struct(F.coalesce("touched", F.lit(-(2**62))), F.col("vector").isNotNull())).alias("r")).select("key", "r.vector")
    finite: Callable[[Column], Column] = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return now.where((F.size("vector") == dims) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        if batch.num_rows:
            # scaled first: tiny and huge vectors have norms beyond a float's range
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        raw = np.ascontiguousarray(x, np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], names=["key", "v"])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(key, v): unit vectors as packed little-endian floats."""
    return vectors.select("key", "vector").mapInArrow(_unit, "key string, v binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty centre takes the point that fits its own worst."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        for a in range(0, len(x), 8192):
            s = x[a : a + 8192] @ c.T
            near[a : a + 8192], best[a : a + 8192] = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = np.flatnonzero(norm[:, 0] < 1e-9)
        if len(empty):
            sums[empty] = x[np.argsort(best)[: len(empty)]]
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = (sums / norm).astype(np.float32)
    return c


@dataclass
class Centroids:
    leaves: np.ndarray  # lists x dims
    graph: np.ndarray  # lists x GRAPH
    tops: np.ndarray  # entry points x dims
    entry: np.ndarray  # entry points x their nearest lists

    @classmethod
    def of(cls, leaves: np.ndarray, tops: np.ndarray) -> Centroids:
        k = len(leaves)
        graph = np.empty((k, min(GRAPH, k)), np.int32)
        step = max(1, min(1024, (1 << 23) // k))
        for a in range(0, k, step):
            graph[a : a + step] = np.argpartition(leaves[a : a + step] @ leaves.T, k - graph.shape[1], axis=1)[:, k - graph.shape[1] :]
        near = np.argpartition(-(tops @ leaves.T), min(ENTRY, k) - 1, axis=1)[:, : min(ENTRY, k)]
        return cls(leaves, graph, tops, near.astype(np.int32))

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 7) -> Centroids:
        """Both levels on one matrix."""
        rng = np.random.default_rng(seed)
        tops = _kmeans(x, max(1, round(lists**0.5)), rng)
        near = nearest_top(x, tops)
        parts = [x[near == t] for t in range(len(tops))]
        return cls.of(np.concatenate([_kmeans(p, max(1, round(lists * len(p) / len(x))), rng) for p in parts if len(p)]), tops)

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, similarities) of the n nearest centroids of each row, nearest first: always n distinct lists."""
        n, entries = min(n, len(self.leaves)), min(ENTRIES, len(self.tops))
        ids, sim, first = np.empty((len(x), n), np.int32), np.empty((len(x), n), np.float32), np.empty((len(x), entries), np.int32)
        for a in range(0, len(x), 8192):
            s = x[a : a + 8192] @ self.tops.T
            best = np.argpartition(-s, entries - 1, axis=1)[:, :entries]
            first[a : a + 8192] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
        order = np.lexsort(first.T[::-1])
        for a in range(0, len(x), TOGETHER):
            at = order[a : a + TOGETHER]
            ids[at], sim[at] = self._search(x[at], first[at], n)
        return ids, sim

    def _search(self, x: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of the graph from the lists of the best entry points, of all rows together, until every list of every row's beam has been expanded.

        A list is looked at once, by all rows, so the search ends after as many steps as there are lists, whatever ties there are.
        One that is in no beam when it is looked at never will be: a beam's least similarity only rises.
        The graph may fall apart: where fewer than n lists were reached, further entry points are taken, and in the end every list.
        """
        beam = min(len(self.leaves), max(BEAM, n + n // 4))
        best = np.full((len(x), beam), -9, np.float32)
        seen, lists, sims = np.zeros(len(self.leaves), bool), [], []

        def unseen(near: np.ndarray) -> np.ndarray:
            there = np.zeros(len(seen), bool)
            there[near] = True
            return np.flatnonzero(there & ~seen)

        new, more = unseen(self.entry[first]), None
        while True:
            while len(new):
                seen[new] = True
                s = x @ self.leaves[new].T
                lists.append(new)
                sims.append(s)
                best = np.partition(np.concatenate([best, s], 1), len(new), axis=1)[:, len(new) :]
                new = unseen(self.graph[new[(s >= best.min(1)[:, None]).any(0)]])
            if sum(map(len, lists)) >= n:
                break
            more = iter(np.argsort(-(self.tops @ x.sum(0)), kind="stable")) if more is None else more
            top = next(more, None)
            new = np.flatnonzero(~seen) if top is None else unseen(self.entry[top])
        every, s = np.concatenate(lists), np.concatenate(sims, 1)
        row, col = np.divmod(np.flatnonzero(s >= np.partition(best, beam - n, axis=1)[:, beam - n, None]), len(every))
        got = s[row, col]
        at = np.lexsort((every[col], -got, row))
        # of lists as similar as the n-th those of the least numbers
        at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < n]
        return every[col[at]].reshape(-1, n), got[at].reshape(-1, n)


def nearest_top(x: np.ndarray, tops: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 8192] @ tops.T).argmax(1) for a in range(0, max(1, len(x)), 8192)])


def fit(units: DataFrame, count: int, list_size: int = 256, max_lists: int = 262144, max_sample: int = 65536, per_list: int = 32, dims: int = DIMS) -> Centroids:
    """Centroids of ``count`` vectors: one list for every ``list_size`` of them (``max_lists`` at most, a bound of what is sent to tasks: 67 million vectors; beyond it lists grow).

    The tops, as many as the root of the number of lists, are fitted on at most ``max_sample`` vectors; the lists within
    each top on ``per_list`` vectors a list.  Both are chosen by hash.  A top that holds more than ``max_sample``
    of the chosen is fitted in parts, so no task gets a group without bound.
    """
    lists = int(min(max_lists, max(1, count // list_size)))
    some: Callable[[int, float], Column] = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, n / count) * (1 << 20))
    x = _matrix(units.where(some(3, max_sample)).limit(max_sample + max_sample // 8).select("v").toArrow().column(0), dims)
    if not len(x):
        x = _matrix(units.limit(max_sample).select("v").toArrow().column(0), dims)
    x = x[np.lexsort(x.T[:2])]
    tops = _kmeans(x, max(1, round(lists**0.5)), np.random.default_rng(7))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_top(_matrix(batch.column(1), dims), tops)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], names=["top", "key", "v"])

    chosen = write_stage(units.where(some(5, per_list * lists)).select("key", "v").mapInArrow(place, "top int, key string, v binary"), "chosen")
    # one row a top
    parts = chosen.groupBy("top").agg(F.ceil(F.count("*") / max_sample).cast("int").alias("parts"))
    grouped = chosen.join(F.broadcast(parts), "top").withColumn("part", F.pmod(F.xxhash64("key", F.lit(9)), F.col("parts")).cast("int"))

    def leaves(group: pa.Table) -> pa.Table:
        g = _matrix(group.sort_by("key").column("v"), dims)
        c = _kmeans(g, max(1, round(len(g) / per_list)), np.random.default_rng(7))
        return pa.table({"top": pa.array([group.column("top")[0].as_py()] * len(c), pa.int32()), "v": pa.array([r.tobytes() for r in c], pa.binary())})

    got = grouped.select("top", "part", "key", "v").groupBy("top", "part").applyInArrow(leaves, "top int, v binary").select("v").toArrow().column(0)
    leaf = _matrix(got, dims) if len(got) else tops
    # the order of collected rows is not fixed: sorted, a list's number is
    return Centroids.of(leaf[np.lexsort(leaf.T[:2])], tops)


def placed(units: DataFrame, centroids: Centroids, replicas: int, ratio: float, dims: int = DIMS) -> DataFrame:
    """(key, v, lists): the lists whose squared distance is at most ``ratio`` times the least one, nearest first; a vector is held once."""
    # what is found of the gathered rows is bounded too
    many = max(1024, min(GATHERED, (1 << 22) // max(1, replicas)))

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sim = centroids.nearest(_matrix(rows.column(1), dims), replicas)
        for a in range(0, rows.num_rows, 1024):
            d = 2 - 2 * sim[a : a + 1024]
            near = d <= ratio * np.maximum(d[:, :1], 1e-6)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], near.sum(1).cumsum()]), pa.int32()), pa.array(ids[a : a + 1024][near], pa.int32()))
            part = rows.slice(a, 1024).combine_chunks()
            yield pa.RecordBatch.from_arrays([part.column(0).chunk(0), part.column(1).chunk(0), lists], names=["key", "v", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                held.append(batch.slice(a, 1024))
                n += held[-1].num_rows
                if n >= many:
                    yield from search(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield from search(pa.Table.from_batches(held))

    return units.select("key", "v").mapInArrow(run, "key string, v binary, lists array<int>")


def assign(placed: DataFrame) -> DataFrame:
    """(list, nth, key, v): a row for each list of a vector; ``nth``: 0 for its nearest."""
    return placed.select("key", "v", F.posexplode("lists").alias("nth", "list"))


def classes(units: DataFrame) -> DataFrame:
    """(key, rep): the least key among the exact copies of each unit vector."""
    reps = units.groupBy("v").agg(F.min("key").alias("rep"))
    return units.join(reps, "v").select("key", "rep")


def _prepared(vectors: DataFrame, dims: int) -> tuple[DataFrame, DataFrame, int]:
    """(units of all keys, units of one key per class of copies, how many classes), written."""
    units = write_stage(unit_vectors(usable(vectors, dims)), "units")
    reps = write_stage(units.groupBy("v").agg(F.min("key").alias("key")).select("key", "v"), "reps")
    return units, reps, reps.count()


def similar_pairs(
    vectors: DataFrame, min_similarity: float = 0.9, list_size: int = 256, replicas: int = 6, ratio: float = 1.5, block: int = 4096, max_copies: int = 16, dims: int = DIMS, **fitting: int
) -> DataFrame:
    """(key_a, key_b, similarity): unordered pairs of usable vectors whose cosine is at least ``min_similarity``.

    Found where the two share a list.  A class of at most ``max_copies`` exact copies is expanded into all
    its pairs; of a larger class the least key stands for all, and every copy is paired with it,
    so no link is lost and no group gives pairs in the square of its size.  Null keys and unusable vectors give no pair; empty tables none.
    """
    units, reps, count = _prepared(vectors, dims)
    if count == 0:
        return units.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0.0).alias("similarity"))
    lists = assign(write_stage(placed(reps, fit(reps, count, list_size, dims=dims, **fitting), replicas, ratio, dims), "lists"))
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # a list of b blocks: block pairs i <= j, each row sent to the b pairs that hold its block
    rows = lists.join(F.broadcast(sizes), "list").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "v")

    def compare(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v"), dims)
        mine = group.column("mine").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        keys = np.array(group.column("key").to_pylist(), dtype=object)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a_out, b_out, s_out = [], [], []
        for a in range(0, len(left), 1024):
            part = left[a : a + 1024]
            s = x[part] @ x[right].T
            r, c = np.nonzero(s >= min_similarity - 1e-4)
            if not len(r):
                continue
            ka, kb = part[r], right[c]
            keep = ka < kb if i == j else np.ones(len(ka), bool)
            ka, kb = ka[keep], kb[keep]
            exact = np.einsum("ij,ij->i", x[ka].astype(np.float64), x[kb].astype(np.float64))
            keep = exact >= min_similarity - 1e-7
            a_out.append(keys[ka[keep]])
            b_out.append(keys[kb[keep]])
            s_out.append(exact[keep])
        a_, b_ = (np.concatenate(q) if q else np.empty(0, object) for q in (a_out, b_out))
        s_ = np.concatenate(s_out) if s_out else np.empty(0)
        lo = np.where(a_ < b_, a_, b_) if len(a_) else a_
        hi = np.where(a_ < b_, b_, a_) if len(a_) else a_
        return pa.table({"key_a": pa.array(lo.tolist(), pa.string()), "key_b": pa.array(hi.tolist(), pa.string()), "similarity": pa.array(s_, pa.float64())})

    found = rows.groupBy("list", "i", "j").applyInArrow(compare, "key_a string, key_b string, similarity double")
    near = found.groupBy("key_a", "key_b").agg(F.max("similarity").alias("similarity"))
    copies = write_stage(classes(units), "classes")
    others = copies.where("key <> rep")
    if others.isEmpty():
        return near
    # small classes are expanded; of a larger one the representative stands for all, and each copy is paired with it
    size = others.groupBy("rep").agg((F.count("*") + 1).alias("size"))
    sized = copies.join(size, "rep", "left").withColumn("small", F.coalesce(F.col("size") <= max_copies, F.lit(True)))
    shown = sized.where(F.col("small") | (F.col("key") == F.col("rep")))
    a, b = shown.select(F.col("key").alias("ka"), F.col("rep").alias("key_a")), shown.select(F.col("key").alias("kb"), F.col("rep").alias("key_b"))
    across = near.join(a, "key_a").join(b, "key_b").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")
    one = F.lit(1.0).alias("similarity")
    multi = sized.where("small AND size > 1").select("rep", "key")
    within = multi.alias("x").join(multi.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"), one)
    star = sized.where("NOT small AND key <> rep").select(F.col("rep").alias("key_a"), F.col("key").alias("key_b"), one)
    return across.unionByName(within).unionByName(star)


def _compare(stored: DataFrame, probes: DataFrame, k: int, block: int, dims: int) -> DataFrame:
    """(rep, near, similarity): of each list that a probe names, its k + 1 most similar entries above the probe's ``least``.

    A long list, and one that many queries probe, is worked in pairs of blocks: entries are sent to each block of probes and
    probes to each block of entries.
    """
    # at most one row a list
    blocks = stored.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("b")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("c")), "list")
    cut: Callable[[str], Column] = lambda n: F.pmod(F.xxhash64("key", F.lit(11)), F.col(n)).cast("int")
    every: Callable[[str], Column] = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(F.broadcast(blocks), "list").withColumn("j", cut("c")).withColumn("i", every("b")).select("list", "i", "j", "key", "v", "least")
    right = stored.join(F.broadcast(blocks), "list").withColumn("i", cut("b")).withColumn("j", every("c")).select("list", "i", "j", "key", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["rep", "near", "similarity"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)
        x, y = _matrix(left.column("v"), dims), _matrix(right.column("v"), dims)
        kx, ky = (np.array(t.column("key").to_pylist(), dtype=object) for t in (left, right))
        least = left.column("least").to_numpy().astype(np.float32)
        rep, near, sim = [], [], []
        for a in range(0, len(x), 512):
            s = x[a : a + 512] @ y.T
            n = min(k + 1, s.shape[1])
            ids = np.argpartition(-s, n - 1, axis=1)[:, :n]
            got = np.take_along_axis(s, ids, 1)
            r, c = np.nonzero(got >= least[a : a + 512, None])
            rep.append(kx[a + r])
            near.append(ky[ids[r, c]])
            sim.append(got[r, c].astype(np.float64))
        r, m, s = np.concatenate(rep), np.concatenate(near), np.concatenate(sim)
        keep = r != m
        return pa.table([pa.array(r[keep].tolist(), pa.string()), pa.array(m[keep].tolist(), pa.string()), pa.array(s[keep], pa.float64())], names=names)

    on = ["list", "i", "j"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(search, "rep string, near string, similarity double")


def top_k(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, list_size: int = 256, replicas: int = 2, ratio: float = 1.3, probe_power: float = 0.8, probe_ratio: float = 4.0, first: int = 8, block: int = 8192,
    dims: int = DIMS, **fitting: int,
) -> DataFrame:
    """(key, neighbour, similarity, rank): the k other vectors most similar to each query (ties by key).

    ``queries``: a frame with ``key`` (default: every usable vector).  Of L lists a query probes the nearest
    L to ``probe_power`` (at least ``first``), so the share falls as lists grow in number, and of these the ones within ``probe_ratio`` of its
    nearest squared distance.  The ``first`` nearest are compared before the others, which then give only what is no
    less similar than the k-th found so far.  Copies of a query's own vector come first; of
    a class of copies at most k + 1 are looked at, which is enough for k results.
    Null keys and unusable vectors are neither queries nor results; empty tables give no rows.
    """
    units, reps, count = _prepared(vectors, dims)
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("neighbour", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if count == 0:
        return units.sparkSession.createDataFrame([], out)
    centroids = fit(reps, count, list_size, dims=dims, **fitting)
    copies = write_stage(classes(units), "classes")
    asked = copies if queries is None else copies.join(queries.select("key").where("key IS NOT NULL").distinct(), "key", "left_semi")
    q = reps.join(asked.select(F.col("rep").alias("key")).distinct(), "key", "left_semi")
    stored = assign(write_stage(placed(reps, centroids, replicas, ratio, dims), "stored"))
    probes = assign(write_stage(placed(q, centroids, max(first, int(np.ceil(len(centroids.leaves) ** probe_power))), probe_ratio, dims), "probes"))
    one = _compare(stored, probes.where(F.col("nth") < first).withColumn("least", F.lit(-2.0)), k, block, dims).groupBy("rep", "near").agg(F.max("similarity").alias("similarity"))
    ranked: Callable[[DataFrame], DataFrame] = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "near"))).where(F.col("n") <= k)
    one = write_stage(ranked(one), "first")
    # float rounding differs between blocks: a little less than the k-th is still looked at
    kth = one.where(F.col("n") == k).select(F.col("rep").alias("key"), (F.col("similarity") - 1e-5).alias("least"))
    more = probes.where(F.col("nth") >= first).join(kth, "key", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    found = one.drop("n").unionByName(_compare(stored, more, k, block, dims)).groupBy("rep", "near").agg(F.max("similarity").alias("similarity"))
    best = ranked(found).drop("n")
    # copies: at most k + 1 of a class matter
    some = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("near"), F.col("key").alias("neighbour"))
    others = best.join(some, "near").select("rep", "neighbour", "similarity")
    own = some.select(F.col("near").alias("rep"), "neighbour", F.lit(1.0).alias("similarity"))
    full = asked.join(others.unionByName(own), "rep").where("key <> neighbour")
    w = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    return full.select("key", "neighbour", "similarity", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
