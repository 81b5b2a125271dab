"""Comparison of snapshots: trees, lines, declarations, blame runs, and change feeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage


def tree_compare(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Changes between two trees (path, oid, mode): modified, added, deleted, renamed_exact_blob.

    A path on both sides is modified unless oid and mode are equal.  Of the rest, a pair with
    the same oid and mode is a rename if the oid is the only one of its kind left on either side.
    ``by``: columns that separate trees compared at once.  Columns: by, change, old_path, new_path, old_oid, new_oid.
    """
    by = by or []
    o = old.select(*by, "path", F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"), F.lit(True).alias("was"))
    n = new.select(*by, "path", F.col("oid").alias("new_oid"), F.col("mode").alias("new_mode"), F.lit(True).alias("now"))
    both = o.join(n, [*by, "path"], "full")
    same = F.col("old_oid").eqNullSafe(F.col("new_oid")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))
    modified = both.where(F.col("was") & F.col("now") & ~same).select(*by, F.lit("modified").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), "old_oid", "new_oid")
    gone = both.where(F.col("now").isNull()).select(*by, F.col("path").alias("old_path"), F.col("old_oid").alias("oid"), F.col("old_mode").alias("mode"))
    come = both.where(F.col("was").isNull()).select(*by, F.col("path").alias("new_path"), F.col("new_oid").alias("oid"), F.col("new_mode").alias("mode"))
    # an oid that a third of all rows bears is no rename: counted by aggregates, never gathered
    g = gone.where("oid IS NOT NULL").groupBy(*by, "oid", "mode").agg(F.count("*").alias("n"), F.min("old_path").alias("old_path")).where("n = 1").drop("n")
    c = come.where("oid IS NOT NULL").groupBy(*by, "oid", "mode").agg(F.count("*").alias("n"), F.min("new_path").alias("new_path")).where("n = 1").drop("n")
    g1 = gone.where("oid IS NOT NULL").groupBy(*by, "oid").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    c1 = come.where("oid IS NOT NULL").groupBy(*by, "oid").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    renamed = g.join(c, [*by, "oid", "mode"]).join(g1, [*by, "oid"]).join(c1, [*by, "oid"]).select(*by, F.lit("renamed_exact_blob").alias("change"), "old_path", "new_path", F.col("oid").alias("old_oid"), F.col("oid").alias("new_oid"))
    none = F.lit(None).cast("string")
    deleted = gone.join(renamed.select(*by, "old_path"), [*by, "old_path"], "left_anti").select(*by, F.lit("deleted").alias("change"), "old_path", none.alias("new_path"), F.col("oid").alias("old_oid"), none.alias("new_oid"))
    added = come.join(renamed.select(*by, "new_path"), [*by, "new_path"], "left_anti").select(*by, F.lit("added").alias("change"), none.alias("old_path"), "new_path", none.alias("old_oid"), F.col("oid").alias("new_oid"))
    return modified.unionByName(renamed).unionByName(deleted).unionByName(added)


def scope_changes(changes: DataFrame, prefix: str) -> DataFrame:
    """Changes as seen from a subtree; a rename across its edge becomes a boundary change."""
    inside = lambda c: F.coalesce(F.col(c).startswith(prefix), F.lit(False))
    o, n = inside("old_path"), inside("new_path")
    change = F.when((F.col("change") == "renamed_exact_blob") & o & ~n, "scope_boundary_out").when((F.col("change") == "renamed_exact_blob") & ~o & n, "scope_boundary_in").otherwise(F.col("change"))
    return changes.where(o | n).withColumn("change", change)


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Observations between two scans (id, path, revision, status, bytes): kind per path that differs.

    added; modified (both have a body, another revision); coverage_changed (status or size only, or a body came
    or went); deleted, or ignored_or_excluded where the old row had no body.
    """
    o = old.select("path", F.struct("revision", "status", "bytes").alias("o"))
    n = new.select("path", F.struct("revision", "status", "bytes").alias("n"))
    j = o.join(n, "path", "full")
    kind = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull() & F.col("o.revision").isNull(), "ignored_or_excluded")
        .when(F.col("n").isNull(), "deleted")
        .when(F.col("o.revision").isNotNull() & F.col("n.revision").isNotNull() & (F.col("o.revision") != F.col("n.revision")), "modified")
        .when(~F.col("o").eqNullSafe(F.col("n")), "coverage_changed")
    )
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "kind", F.col("o.revision").alias("old_revision"), F.col("n.revision").alias("new_revision"))


def retained(windows: DataFrame, most_windows: int = 256, most_rows: int = 4096) -> DataFrame:
    """Whole windows (generation, rows) to keep: the newest ones within both limits.  One row per generation."""
    w = Window.orderBy(F.desc("generation")).rowsBetween(Window.unboundedPreceding, 0)
    newest = windows.orderBy(F.desc("generation")).limit(most_windows)
    return newest.withColumn("reach", F.sum("rows").over(w)).where(F.col("reach") <= most_rows).drop("reach")


def observations_since(observations: DataFrame, windows: DataFrame, after: int, upto: int) -> tuple[DataFrame, bool]:
    """Rows of generations in (after, upto], and whether every window is there and complete."""
    w = windows.where((F.col("generation") > after) & (F.col("generation") <= upto))
    row = w.agg(F.countDistinct("generation").alias("n"), F.min(F.col("complete").cast("int")).alias("c")).first()
    complete = row["n"] == upto - after and (upto == after or row["c"] == 1)
    return observations.where((F.col("generation") > after) & (F.col("generation") <= upto)), bool(complete)


def _anchors(a: list[bytes], b: list[bytes], al: int, ah: int, bl: int, bh: int) -> tuple[int, int, int, int] | None:
    """Longest common run around the rarest line of a that b has."""
    count = Counter(a[al:ah])
    places: dict[bytes, list[int]] = {}
    for j in range(bl, bh):
        if b[j] in count:
            places.setdefault(b[j], []).append(j)
    best = None
    i = al
    while i < ah:
        step = 1
        if count[a[i]] <= 64:
            for j in places.get(a[i], ())[:64]:
                x, y, low = i, j, count[a[i]]
                while x > al and y > bl and a[x - 1] == b[y - 1]:
                    x, y = x - 1, y - 1
                    low = min(low, count[a[x]])
                e, f = i + 1, j + 1
                while e < ah and f < bh and a[e] == b[f]:
                    low = min(low, count[a[e]])
                    e, f = e + 1, f + 1
                key = (low, -(e - x), x, y)
                if best is None or key < best[0]:
                    best = (key, x, e, y)
                step = max(step, e - i)
        i += step
    if best is None:
        return None
    _, x, e, y = best
    return x, e, y, y + e - x


def diff_lines(old: bytes, new: bytes) -> list[tuple[int, int, int, int]]:
    """Changed ranges (old from, to, new from, to) of lines, by a histogram of line frequencies; the rest is unchanged runs."""
    a, b = old.split(b"\n"), new.split(b"\n")
    out: list[tuple[int, int, int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        al, ah, bl, bh = stack.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
        if al == ah and bl == bh:
            continue
        mid = _anchors(a, b, al, ah, bl, bh) if al < ah and bl < bh else None
        if mid is None:
            out.append((al, ah, bl, bh))
            continue
        stack.append((mid[1], ah, mid[3], bh))
        stack.append((al, mid[0], bl, mid[2]))
    return sorted(out)


_HUNK = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("old_from", "old_to", "new_from", "new_to")]])


def line_diff(pairs: DataFrame) -> DataFrame:
    """(id, old binary, new binary) -> changed line ranges, half-open, lines from 0; equal bodies and nulls give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, o, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                for h in diff_lines(o.as_py(), n.as_py()):
                    for col, x in zip(out, (i, *h)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.int32()) for c in out[1:]]], names=_HUNK.names)

    return pairs.where("old IS NOT NULL AND new IS NOT NULL AND old <> new").select("id", "old", "new").mapInArrow(run, _HUNK)


def correspond(old: DataFrame, new: DataFrame, complete: Column | None = None) -> DataFrame:
    """Declarations of two snapshots of a file (file, key, digest): unchanged, modified, moved, added, deleted, uncertain.

    Three passes with uniqueness on both sides: same key and digest, same key, same digest.
    What is left is added or deleted, or uncertain where ``complete`` is false.
    """
    complete = F.lit(True) if complete is None else complete
    only = lambda df, *k: df.groupBy("file", *k).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    out, o, n = None, old, new
    for keys, state in ((("key", "digest"), "unchanged"), (("key",), "modified"), (("digest",), "moved")):
        m = only(o, *keys).withColumnRenamed("id", "old_id").join(only(n, *keys).withColumnRenamed("id", "new_id"), ["file", *keys])
        m = m.select("file", F.lit(state).alias("state"), "old_id", "new_id")
        o = o.join(m.select("file", F.col("old_id").alias("id")), ["file", "id"], "left_anti")
        n = n.join(m.select("file", F.col("new_id").alias("id")), ["file", "id"], "left_anti")
        out = m if out is None else out.unionByName(m)
    none = F.lit(None).cast("long")
    lost = o.select("file", F.when(complete, "deleted").otherwise("uncertain").alias("state"), F.col("id").alias("old_id"), none.alias("new_id"))
    come = n.select("file", F.when(complete, "added").otherwise("uncertain").alias("state"), none.alias("old_id"), F.col("id").alias("new_id"))
    return out.unionByName(lost).unionByName(come)


def line_fingerprints(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 16))


def blame_runs(lines: DataFrame, by: list[str]) -> DataFrame:
    """Contiguous runs of lines with the same commit: gaps and islands.  ``lines``: by, line, oid."""
    w = Window.partitionBy(*by).orderBy("line")
    v = Window.partitionBy(*by, "oid").orderBy("line")
    r = lines.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).withColumn("gap", F.col("line") - F.row_number().over(w))
    return r.groupBy(*by, "oid", "island", "gap").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("island", "gap")


_LINES = "path string, line int, oid string"


def blame(versions: DataFrame) -> DataFrame:
    """(path, line, oid): the commit that each line of a file's last version comes from.

    ``versions``: path, nth, oid, bytes - a file's successive bodies, oldest first; a line that a comparison finds unchanged keeps its commit.
    A null body stands for a file that was not there.  A file's versions are compared in one task: history caps them.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("nth")
        owners: list[str] = []
        before: bytes | None = None
        for oid, body in zip(group.column("oid").to_pylist(), group.column("bytes").to_pylist()):
            if body is None:
                owners, before = [], None
                continue
            n = len(body.split(b"\n"))
            if before is None:
                owners = [oid] * n
            else:
                new, at = [], 0
                for a, b, c, d in diff_lines(before, body):
                    new += owners[at:a] + [oid] * (d - c)
                    at = b
                owners = new + owners[at:]
            before = body
        if before is not None and before.endswith(b"\n"):
            owners = owners[:-1]
        path = group.column("path")[0].as_py()
        return pa.table({"path": pa.array([path] * len(owners), pa.string()), "line": pa.array(range(1, len(owners) + 1), pa.int32()), "oid": pa.array(owners, pa.string())})

    return versions.where("path IS NOT NULL").select("path", "nth", "oid", "bytes").groupBy("path").applyInArrow(run, _LINES)


def tree_steps(trees: list[DataFrame], most: int = 256) -> DataFrame:
    """Changes of all steps between successive trees (newest first) in one comparison, with the step's number."""
    parts = [t.select("path", "oid", "mode", F.lit(k).alias("step")) for k, t in enumerate(trees[: most + 1])]
    new = old = None
    for k, t in enumerate(parts):
        if k + 1 < len(parts):
            new = t if new is None else new.unionByName(t)
        if k > 0:
            b = t.withColumn("step", F.col("step") - 1)
            old = b if old is None else old.unionByName(b)
    return tree_compare(old, new, ["step"])


def history_of(path: str, trees: list[DataFrame], most: int = 256) -> list[dict]:
    """Changes of one path through successive trees, newest first, following exact renames backward.

    All steps are compared at once; only changes of the path, and of the names it had before, are read - as many as there are steps.
    """
    if len(trees) < 2:
        return []
    changes = write_stage(tree_steps(trees, most), "steps")
    names = {path}
    while True:
        here = changes.where(F.col("new_path").isin(sorted(names)) | F.col("new_path").isNull() & F.col("old_path").isin(sorted(names))).collect()
        more = {r.old_path for r in here if r.old_path is not None} - names
        if not more:
            break
        names |= more
    out, at = [], path
    by: dict[int, list] = {}
    for r in here:
        by.setdefault(r.step, []).append(r)
    for k in range(min(len(trees) - 1, most)):
        row = min((r for r in by.get(k, ()) if r.new_path == at or r.new_path is None and r.old_path == at), key=lambda r: r.change, default=None)
        if row is None:
            continue
        out.append(row.asDict())
        if row["change"] == "added":
            break
        at = row["old_path"] or at
    return out


def since(old: DataFrame, new: DataFrame, by: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """What changed since an earlier tree, seen from a subtree if ``prefix`` is given; paths that differ in nothing give no row."""
    changes = tree_compare(old, new, by)
    return changes if prefix is None else scope_changes(changes, prefix)


def since_uncommitted(committed: DataFrame, working: DataFrame) -> DataFrame:
    """Paths of a working state that differ from the committed one, with their kind; what was never read counts by its status."""
    return change_feed(committed, working).select("path", "kind")


def diff_sizes(pairs: DataFrame) -> DataFrame:
    """(id, removed, added): lines that differ between the two texts of each pair."""
    return line_diff(pairs).groupBy("id").agg(F.sum(F.col("old_to") - F.col("old_from")).alias("removed"), F.sum(F.col("new_to") - F.col("new_from")).alias("added"))
