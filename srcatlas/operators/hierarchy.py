"""Parent links to full hierarchies (problem 6): path, depth, root and descendants of every node, cycles told apart.

Contraction: rows are range-partitioned by columns along which parents tend to be near
(member and time for commits), each partition follows its own chains to the
node where they leave it, and the fragments so found form a quotient forest with
one row per fragment, which is solved in the same way with fewer partitions until it
fits one task.  Where a round doesn't shrink the forest, its quotient is
solved by pointer doubling, in a number of rounds logarithmic in its depth.
Expansion joins each node with its fragment's solution.  A cycle within a
partition is found there; one across partitions is a cycle of the quotient.

Scale: per level one range shuffle of the level's rows, one join of its exits and
one of its fragments; the forest is never collected.  A range partition may
hold a third of one member's rows like any others, since members are cut by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage

#: rows that one task may hold
TASK_ROWS = 150_000


def _contract(kind: pa.DataType):
    """Follows chains within a partition: (id, parent, w) -> (id, part, top, exit, own, dist, cyclic); own: the weight of a top's link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parents: list = []
        weights: list = []
        for b in batches:
            ids += b.column(0).to_pylist()
            parents += b.column(1).to_pylist()
            weights += b.column(2).to_pylist()
        if not ids:
            return
        part = TaskContext.get().partitionId()
        at = {x: i for i, x in enumerate(ids)}
        n = len(ids)
        up = [at.get(p, -1) if p is not None else -1 for p in parents]
        top, dist, state = [-1] * n, [0] * n, bytearray(n)  # state: 0 new, 1 on the stack, 2 done, 3 cyclic
        for i in range(n):
            if state[i]:
                continue
            stack, x = [], i
            while x >= 0 and not state[x]:
                state[x] = 1
                stack.append(x)
                x = up[x]
            if x >= 0 and state[x] in (1, 3):
                for y in stack:
                    state[y] = 3
                continue
            for y in reversed(stack):
                state[y] = 2
                if up[y] < 0:
                    top[y], dist[y] = y, 0
                else:
                    top[y], dist[y] = top[up[y]], dist[up[y]] + weights[y]
        for a in range(0, n, 8192):
            rows = range(a, min(n, a + 8192))
            done = [state[i] == 2 for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], kind),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array([ids[top[i]] if d else None for i, d in zip(rows, done)], kind),
                    pa.array([parents[i] if d and up[i] < 0 else None for i, d in zip(rows, done)], kind),
                    pa.array([weights[i] if d and up[i] < 0 else None for i, d in zip(rows, done)], pa.int64()),
                    pa.array([dist[i] if d else None for i, d in zip(rows, done)], pa.int64()),
                    pa.array([not d for d in done], pa.bool_()),
                ],
                names=["id", "part", "top", "exit", "own", "dist", "cyclic"],
            )

    return run


def _trails(kind: pa.DataType, only_wanted: bool):
    """(id, parent, hop, part, dist, cyclic, wanted, root, depth, upper, lost) -> (id, root, depth, trail, cyclic) of the wanted nodes or of all.

    Root, depth and the trail above come from the row of the fragment's top; the trail runs from
    below the root to the node.  Links within a part are local, whatever parts share the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(11)]
        for b in batches:
            for c, x in zip(cols, b.columns):
                c += x.to_pylist()
        ids, parents, hops, parts, dist, cyclic, wanted, root, depth, upper, lost = cols
        at = {x: i for i, x in enumerate(ids)}
        up = [-1] * len(ids)
        for i, p in enumerate(parents):
            j = at.get(p, -1) if p is not None and not cyclic[i] else -1
            up[i] = j if j >= 0 and parts[j] == parts[i] and not cyclic[j] else -1
        want = [i for i in range(len(ids)) if wanted[i]] if only_wanted else range(len(ids))
        for a in range(0, len(want), 2048):
            out: list[list] = [[], [], [], [], []]
            for i in want[a : a + 2048]:
                t: list = []
                x = i
                while up[x] >= 0:
                    t.append(ids[x])
                    t += reversed(hops[x] or ())
                    x = up[x]
                bad = bool(cyclic[i] or lost[x])
                if not bad:
                    t += reversed(upper[x] or ())
                    t.reverse()
                row = (ids[i], None, None, None, True) if bad else (ids[i], root[x], None if depth[x] is None else depth[x] + dist[i], t, False)
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (kind, kind, pa.int64(), pa.list_(kind), pa.bool_()))], names=["id", "root", "depth", "trail", "cyclic"])

    return run


def _double(q: DataFrame, with_path: bool) -> DataFrame:
    """Pointer doubling on (id, parent, w, hop): (id, root, depth, trail, cyclic); trail: from below the root to the node."""
    own = F.concat(F.coalesce("hop", F.array()), F.array("id")) if with_path else F.lit(None).cast(q.schema["hop"].dataType)
    s = write_stage(q.select("id", F.coalesce("parent", "id").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(F.col("w")).cast("long").alias("depth"), F.when(F.col("parent").isNotNull(), own).alias("trail"), F.col("parent").isNull().alias("done")), "doubling")
    # a parent that is no node ends the chain at its child
    known = s.select(F.col("id").alias("anc"))
    s = s.join(known.withColumn("there", F.lit(True)), "anc", "left").withColumn("lost", F.col("there").isNull())
    s = write_stage(s.select("id", F.when(F.col("lost"), F.col("id")).otherwise(F.col("anc")).alias("anc"), F.when(F.col("lost"), 0).otherwise(F.col("depth")).cast("long").alias("depth"), F.when(~F.col("lost"), F.col("trail")).alias("trail"), (F.col("done") | F.col("lost")).alias("done")), "doubling")
    left = s.where(~F.col("done")).count()
    while left:
        up = s.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("depth").alias("more"), F.col("trail").alias("above"), F.col("done").alias("ends"))
        moved = s.where(~F.col("done")).join(up, "anc")
        trail = F.concat(F.coalesce("above", F.array()), "trail") if with_path else F.col("trail")
        moved = moved.select("id", F.col("next").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"), trail.alias("trail"), F.col("ends").alias("done"))
        s = write_stage(s.where("done").unionByName(moved), "doubling")
        now = s.where(~F.col("done")).count()
        if now == left:
            # every finite depth below twice the last reach would have ended in this round: the rest is cyclic
            break
        left = now
    fin = F.col("done")
    return s.select("id", F.when(fin, F.col("anc")).alias("root"), F.when(fin, F.col("depth")).alias("depth"), F.when(fin, F.col("trail")).alias("trail"), (~fin).alias("cyclic"))


def _solve(q: DataFrame, count: int, order: list[str], with_path: bool, task_rows: int) -> DataFrame:
    """(id, parent, w, hop, *order) -> (id, root, depth, trail, cyclic)."""
    kind = q.schema["id"].dataType
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.int64() if isinstance(kind, T.LongType) else pa.string()
    parts = max(1, -(-count // task_rows))
    # a single task only where the count says that it fits one
    placed = q.coalesce(1) if parts == 1 else q.repartitionByRange(parts, *order)
    found = T.StructType(
        [T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("top", kind), T.StructField("exit", kind), T.StructField("own", T.LongType()), T.StructField("dist", T.LongType()), T.StructField("cyclic", T.BooleanType())]
    )
    trail_type = T.StructType([T.StructField("id", kind), T.StructField("root", kind), T.StructField("depth", T.LongType()), T.StructField("trail", T.ArrayType(kind)), T.StructField("cyclic", T.BooleanType())])
    none, no_trail = F.lit(None).cast(kind), F.lit(None).cast(T.ArrayType(kind))

    def trails(rows: DataFrame, only_wanted: bool) -> DataFrame:
        """Rows are brought together by part and whole paths made last, so none is shuffled."""
        given = {"wanted": F.lit(True), "root": none, "depth": F.lit(None).cast("long"), "upper": no_trail, "lost": F.lit(None).cast("boolean")}
        rows = rows.withColumns({k: v for k, v in given.items() if k not in rows.columns})
        together = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "part")
        return together.select("id", "parent", "hop", "part", "dist", "cyclic", "wanted", "root", "depth", "upper", "lost").mapInArrow(_trails(arrow, only_wanted), trail_type)

    frag = write_stage(placed.select("id", "parent", "w").mapInArrow(_contract(arrow), found), "fragments")
    links = frag.join(q.select("id", "parent", "hop"), "id") if with_path else frag
    if parts == 1:
        if with_path:
            return trails(links.withColumn("root", F.col("id")).withColumn("depth", F.lit(0).cast("long")), False)
        return frag.select("id", F.col("top").alias("root"), F.col("dist").alias("depth"), no_trail.alias("trail"), "cyclic")
    tops = frag.where("id = top")
    inner = frag.select(F.col("id").alias("exit"), F.col("top").alias("parent"), F.coalesce("dist", F.lit(0)).alias("below"), F.col("cyclic").alias("into_cycle"))
    edges = tops.select("id", "exit", "own").where("exit IS NOT NULL").hint("shuffle_hash").join(inner, "exit")
    edges = edges.withColumn("w", F.col("below") + F.col("own")).drop("below", "own")
    if with_path:
        # only nodes that other fragments hang on need their trail before the quotient is solved
        asked = edges.select(F.col("exit").alias("id"), F.lit(True).alias("wanted")).distinct()
        t = trails(links.join(asked.hint("shuffle_hash"), "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))), True)
        edges = edges.join(t.select(F.col("id").alias("exit"), F.col("trail").alias("hop")), "exit", "left")
    else:
        edges = edges.withColumn("hop", no_trail)
    edges = write_stage(edges, "exits")
    rest = tops.select("id").join(edges.select("id").hint("shuffle_hash"), "id", "left_anti").select("id", none.alias("parent"), F.lit(0).cast("long").alias("w"), no_trail.alias("hop"))
    # fragments that hang on a local cycle stay in the quotient as roots of their own, so that what hangs on them is found too
    hanging = edges.where("into_cycle").select("id", none.alias("parent"), F.lit(0).cast("long").alias("w"), no_trail.alias("hop"))
    live = edges.where(~F.col("into_cycle")).select("id", "parent", "w", "hop")
    quotient = live.unionByName(rest).unionByName(hanging)
    # hash tables are built of the fragments: no side is small enough by its nature to be broadcast
    quotient = write_stage(quotient.hint("shuffle_hash").join(q.select("id", *[c for c in order if c != "id"]), "id"), "quotient")
    left = quotient.count()
    if left > 0.6 * count and left > task_rows:
        solved = _double(quotient, with_path)
    else:
        solved = _solve(quotient, left, order, with_path, task_rows)
    bad = hanging.select(F.col("id").alias("root"), F.lit(True).alias("on_cycle"))
    solved = solved.join(bad.hint("shuffle_hash"), "root", "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("on_cycle", F.lit(False)))
    solved = solved.select(F.col("id").alias("top"), "root", "depth", F.col("trail").alias("upper"), F.col("cyclic").alias("lost"))
    if with_path:
        above = solved.select(F.col("top").alias("id"), "root", "depth", "upper", "lost")
        return trails(links.join(above.hint("shuffle_hash"), "id", "left"), False)
    full = frag.join(solved.drop("upper").hint("shuffle_hash"), "top", "left")
    cyc = F.col("cyclic") | F.coalesce("lost", F.lit(False))
    return full.select("id", F.when(~cyc, F.col("root")).alias("root"), F.when(~cyc, F.col("depth") + F.col("dist")).alias("depth"), no_trail.alias("trail"), cyc.alias("cyclic"))


def hierarchy(links: DataFrame, order: list[str] | None = None, with_path: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, parent) -> (id, root, depth, path, cyclic), one row per distinct non-null id.

    ``order``: further columns of ``links`` along which parents are near their
    children; without any, ids are taken.  A root has depth 0 and a path of itself;
    ``path`` runs from the root to the node (null without ``with_path``: the paths
    of a forest of n nodes have as many entries as its depths sum up to).  A parent that
    is no id means none.  Nodes from which following parents never ends - on a
    cycle, or below one - have ``cyclic`` true and null root, depth and path.
    Of several rows for an id the least parent counts: resolve them before if another should.
    An empty table gives no rows.
    """
    order = order or ["id"]
    extra = [c for c in order if c != "id"]
    one = links.where("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"), *[F.min(c).alias(c) for c in extra])
    return _hierarchy(one, order, with_path, task_rows)


def _hierarchy(one: DataFrame, order: list[str], with_path: bool, task_rows: int) -> DataFrame:
    kind = one.schema["id"].dataType
    q = one.select("id", "parent", F.lit(1).cast("long").alias("w"), F.lit(None).cast(T.ArrayType(kind)).alias("hop"), *[c for c in order if c != "id"])
    q = write_stage(q, "links")
    got = _solve(q, q.count(), [c for c in order if c != "id"] or ["id"], with_path, task_rows)
    path = F.when(~F.col("cyclic"), F.concat(F.array("root"), F.coalesce("trail", F.array()))) if with_path else F.lit(None).cast(T.ArrayType(kind))
    return got.select("id", "root", "depth", path.alias("path"), "cyclic")


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all rooted nodes of ``hierarchy``'s result with paths, each node its own at distance 0."""
    return nodes.where(~F.col("cyclic")).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def descendants(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Proper descendants as rows (ancestor, descendant, distance), of all nodes or those of ``wanted`` (id)."""
    rows = closure(nodes).where("distance > 0")
    return rows if wanted is None else rows.join(wanted.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(id, descendants, height) of every rooted node; counted map-side before the shuffle."""
    return closure(nodes).groupBy(F.col("ancestor").alias("id")).agg((F.count("*") - 1).alias("descendants"), F.max("distance").alias("height"))


def current_commits(commits: DataFrame) -> DataFrame:
    """Current row per oid: latest ``observed_at`` (null earliest, ties are copies); ids as bytes, half their text's size.

    ``parent`` is folded to lower case and stripped; null, empty, all zeros and text that isn't hexadecimal mean none.
    """
    raw = F.lower(F.regexp_replace("parent", r"^\s+|\s+$", ""))
    parent = F.when(raw.rlike("^[0-9a-f]*[1-9a-f][0-9a-f]*$"), F.unhex(raw))
    key = F.unhex(F.col("oid"))
    rows = commits.where("oid IS NOT NULL").select(key.alias("id"), parent.alias("parent"), "member", "observed_at").where("id IS NOT NULL")
    best = rows.groupBy("id").agg(F.max_by(F.struct("parent", "member", "observed_at"), F.struct("observed_at", "parent")).alias("r"))
    return best.select("id", "r.parent", "r.member", "r.observed_at")


def commit_hierarchy(commits: DataFrame, with_path: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """(oid, root, depth, path, cyclic) of every distinct commit over first parents."""
    got = _hierarchy(current_commits(commits), ["member", "observed_at", "id"], with_path, task_rows)
    text = lambda c: F.lower(F.hex(c))
    return got.select(text(F.col("id")).alias("oid"), text(F.col("root")).alias("root"), "depth", F.transform("path", text).alias("path"), "cyclic")


def _gather(kind: pa.DataType):
    """(id, parent, w, c, h, part, dist) -> (id, total, height): sums of c and greatest distances below each node, within parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(7)]
        for b in batches:
            for x, y in zip(cols, b.columns):
                x += y.to_pylist()
        ids, parents, w, total, height, part, dist = cols
        at = {x: i for i, x in enumerate(ids)}
        for i in sorted(range(len(ids)), key=dist.__getitem__, reverse=True):
            j = at.get(parents[i], -1) if parents[i] is not None else -1
            if j >= 0 and part[j] == part[i]:
                total[j] += total[i]
                height[j] = max(height[j], height[i] + w[i])
        for a in range(0, len(ids), 16384):
            e = slice(a, a + 16384)
            yield pa.RecordBatch.from_arrays([pa.array(ids[e], kind), pa.array(total[e], pa.int64()), pa.array(height[e], pa.int64())], names=["id", "total", "height"])

    return run


def _totals(q: DataFrame, count: int, order: list[str], task_rows: int) -> DataFrame | None:
    """(id, parent, w, c, h, *order) of a forest -> (id, total, height); None if a round doesn't shrink it."""
    kind = q.schema["id"].dataType
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.int64() if isinstance(kind, T.LongType) else pa.string()
    parts = max(1, -(-count // task_rows))
    placed = q.coalesce(1) if parts == 1 else q.repartitionByRange(parts, *order)
    found = T.StructType(
        [T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("top", kind), T.StructField("exit", kind), T.StructField("own", T.LongType()), T.StructField("dist", T.LongType()), T.StructField("cyclic", T.BooleanType())]
    )
    frag = placed.select("id", "parent", "w").mapInArrow(_contract(arrow), found).drop("own", "cyclic")
    rows = write_stage(q.join(frag.hint("shuffle_hash"), "id"), "rows")

    def gather(r: DataFrame) -> DataFrame:
        together = r.coalesce(1) if parts == 1 else r.repartitionByRange(parts, "part")
        return together.select("id", "parent", "w", "c", "h", "part", "dist").mapInArrow(_gather(arrow), T.StructType([T.StructField("id", kind), T.StructField("total", T.LongType()), T.StructField("height", T.LongType())]))

    if parts == 1:
        return gather(rows)
    inner = rows.groupBy(F.col("top").alias("id")).agg(F.sum("c").alias("c"), F.max(F.col("dist") + F.col("h")).alias("h"))
    tops = rows.where("id = top").select("id", "exit", F.col("w").alias("own"), *[c for c in order if c != "id"])
    near = rows.select(F.col("id").alias("exit"), F.col("top").alias("parent"), F.col("dist").alias("below"))
    edges = tops.join(near.join(tops.select("exit").hint("shuffle_hash"), "exit", "left_semi").hint("shuffle_hash"), "exit", "left")
    quotient = edges.withColumn("w", F.coalesce(F.col("below") + F.col("own"), F.lit(1)).cast("long")).hint("shuffle_hash").join(inner, "id")
    quotient = write_stage(quotient.select("id", "parent", "w", "c", "h", "exit", "own", *[c for c in order if c != "id"]), "quotient")
    left = quotient.count()
    if left > 0.6 * count and left > task_rows:
        return None
    solved = _totals(quotient.drop("exit", "own"), left, order, task_rows)
    if solved is None:
        return None
    hung = quotient.where("parent IS NOT NULL").select("id", F.col("exit"), "own").hint("shuffle_hash").join(solved, "id")
    hung = hung.groupBy(F.col("exit").alias("id")).agg(F.sum("total").alias("more"), F.max(F.col("height") + F.col("own")).alias("far"))
    r = rows.join(hung.hint("shuffle_hash"), "id", "left")
    return gather(r.withColumn("c", F.col("c") + F.coalesce("more", F.lit(0))).withColumn("h", F.greatest("h", F.coalesce("far", F.lit(0)))))


def _subtrees(one: DataFrame, order: list[str], task_rows: int) -> DataFrame:
    """(id, total, height) of the rooted nodes of ``one``."""
    rooted = _hierarchy(one, order, False, task_rows).where(~F.col("cyclic")).select("id")
    q = one.join(rooted.hint("shuffle_hash"), "id").select("id", "parent", F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("h"), "member", "observed_at")
    q = write_stage(q, "rooted")
    got = _totals(q, q.count(), order, task_rows)
    if got is None:
        got = subtree_sizes(_hierarchy(one, order, True, task_rows)).select("id", (F.col("descendants") + 1).alias("total"), "height")
    return got


def commit_subtrees(commits: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(oid, descendants, height) of every rooted commit, by the same contraction: sums within partitions, then of the
    quotient forest, then within partitions again.  Paths are made only where a round does not shrink the forest."""
    got = _subtrees(write_stage(current_commits(commits), "current"), ["member", "observed_at", "id"], task_rows)
    return got.select(F.lower(F.hex("id")).alias("oid"), (F.col("total") - 1).alias("descendants"), "height")


def commit_descendants(commits: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(oid, root, place, last) of every rooted commit: all descendants of all commits, in one row each.

    ``place`` numbers a tree in pre-order, children by oid, its root 0.  The descendants of a commit are
    the rows of its root whose place is above its own and at most its ``last``.  A place is the sum,
    along the path, of one and the sizes of the earlier siblings' subtrees: a weighted depth.
    """
    order = ["member", "observed_at", "id"]
    one = write_stage(current_commits(commits), "current")
    got = write_stage(_subtrees(one, order, task_rows).select("id", "total"), "totals")
    nodes = one.join(got.hint("shuffle_hash"), "id")
    earlier = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    # roots have no siblings and would be one group
    below = nodes.where("parent IS NOT NULL").withColumn("w", F.coalesce(F.sum("total").over(earlier), F.lit(0)) + 1)
    q = below.unionByName(nodes.where("parent IS NULL").withColumn("w", F.lit(1).cast("long")))
    q = write_stage(q.select("id", "parent", "w", "total", F.lit(None).cast(T.ArrayType(T.BinaryType())).alias("hop"), "member", "observed_at"), "weighted")
    solved = _solve(q.drop("total"), q.count(), order[:2], False, task_rows).select("id", "root", F.col("depth").alias("place"))
    text = lambda c: F.lower(F.hex(c))
    return solved.join(got.hint("shuffle_hash"), "id").select(text("id").alias("oid"), text("root").alias("root"), "place", (F.col("place") + F.col("total") - 1).alias("last"))
