"""Distributed ranks, blame and histories, sweeps and budgets, pages of result sets, escaped lines."""

import pytest
from pyspark.sql import functions as F

from srcatlas.functions.ranks import numbered
from srcatlas.operators import corpus, history, reads, resolution, vectors
from srcatlas.sources import generations as G


def test_numbers_and_sums_in_order(spark):
    rows = [("hot", i * 7 % 500, i % 3) for i in range(500)] + [("a", 1, 5), (None, 2, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(7)
    n = {(r.g, r.o): r.n for r in numbered(df, ["g"], ["o"], "n").collect()}
    assert [n["hot", i] for i in range(500)] == list(range(1, 501)) and (n["a", 1], n[None, 1], n[None, 2]) == (1, 1, 2)
    s = {(r.g, r.o): r.s for r in numbered(df, ["g"], ["o"], "s", F.col("v")).collect()}
    run, by = 0, {o: v for g, o, v in rows if g == "hot"}
    for o in range(500):
        run += by[o]
        assert s["hot", o] == run
    assert sorted(r.n for r in numbered(df, [], ["g", "o"], "n").collect()) == list(range(1, 504))
    assert numbered(df.limit(0), ["g"], ["o"], "n").count() == 0


def test_fair_turns_with_a_hot_root(spark):
    q = [("hot", i, False) for i in range(300)] + [("b", 1000 + i, False) for i in range(5)] + [("c", 2000, False)]
    got = [r.root for r in vectors.fair_turns(spark.createDataFrame(q, "root string, arrived long, background boolean")).orderBy("slot").collect()]
    assert got[:7] == ["b", "c", "hot", "b", "hot", "b", "hot"] and len(got) == 306


def test_batches_in_blocks(spark):
    rows = [("g", i, 10 + i % 3) for i in range(300)]
    got = {r.nth: r.batch for r in vectors.batches(spark.createDataFrame(rows, "g string, nth long, tokens long"), "g", 8, 1000, block=100).collect()}
    want, at = {}, 0
    for b in range(0, 300, 100):
        plan = vectors.plan_batches([t for _, _, t in rows[b : b + 100]], 8, 1000)
        for k, (x, y) in enumerate(plan):
            want |= {b + i: at + k for i in range(x, y)}
        at += len(plan)
    assert got == want


def test_blame_follows_lines_through_versions(spark):
    v = [("p", 1, "c1", b"a\nb\nc\n"), ("p", 2, "c2", b"a\nx\nb\nc\n"), ("p", 3, "c3", b"a\nx\nc\n"), ("q", 1, "c1", b"old\n"), ("q", 2, "c2", None), ("q", 3, "c3", b"old\n"), ("r", 1, "c1", b""), (None, 1, "c1", b"z")]
    df = spark.createDataFrame([(p, n, o, None if b is None else bytearray(b)) for p, n, o, b in v], "path string, nth int, oid string, bytes binary")
    got = {(r.path, r.line): r.oid for r in history.blame(df).collect()}
    assert got == {("p", 1): "c1", ("p", 2): "c2", ("p", 3): "c1", ("q", 1): "c3", ("r", 1): "c1"}
    runs = {(r.oid, r.first_line, r.last_line) for r in history.blame_runs(history.blame(df).where("path = 'p'"), ["path"]).collect()}
    assert runs == {("c1", 1, 1), ("c2", 2, 2), ("c1", 3, 3)}


def test_history_of_a_renamed_path(spark):
    s = "path string, oid string, mode string"
    t = [spark.createDataFrame(x, s) for x in ([("new", "2", "m"), ("o", "9", "m")], [("new", "1", "m"), ("o", "9", "m")], [("old", "1", "m"), ("o", "9", "m")], [("o", "9", "m")])]
    assert [(r["step"], r["change"], r["old_path"]) for r in history.history_of("new", t)] == [(0, "modified", "new"), (1, "renamed_exact_blob", "old"), (2, "added", None)]
    assert history.history_of("none", t) == [] and history.history_of("new", t[:1]) == []


def test_sweep_and_budgets(spark):
    e = spark.createDataFrame([("live", 0.0), ("old", 0.0), ("fresh", 99_000.0), ("unknown", None)], "name string, touched double")
    kept, gone = corpus.sweep(e, spark.createDataFrame([("live",), ("live",)], "name string"), 100_000.0)
    assert {r.name for r in kept.collect()} == {"live", "fresh", "unknown"} and {r.name for r in gone.collect()} == {"old"}
    rows = spark.range(10).withColumn("size", F.lit(5))
    assert corpus.within_budget(rows, 10, 50, "size").count() == 10
    for limits in ((9, 50), (10, 49)):
        with pytest.raises(RuntimeError):
            corpus.within_budget(rows, *limits, "size")
    assert resolution.charged([rows, rows], 20) == 20
    with pytest.raises(RuntimeError):
        resolution.charged([rows, rows], 19)


def test_pages_of_a_result_set(spark, tmp_path):
    sets = G.ResultSets(spark, str(tmp_path))
    sid = sets.save(spark.createDataFrame([(f"p{i}", i) for i in range(1, 8)], "path string, rank int"))
    first, nxt = G.page_of(sets, f"{sid}@0", 5)
    last, end = G.page_of(sets, nxt, 5)
    assert [r.rank for r in first.orderBy("rank").collect()] == [1, 2, 3, 4, 5] and [r.rank for r in last.collect()] == [6, 7] and end is None


def test_escaped_lines_and_spans(spark):
    b = spark.createDataFrame([("r", bytearray(b"ok\nbad \xff\t1\n\xc3\xa9\n")), ("u", bytearray("é\n".encode())), ("n", None), ("e", bytearray(b""))], "revision string, bytes binary")
    assert [(x.revision, x.line, x.text) for x in reads.escaped_lines(b).collect()] == [("r", 2, "bad \\xff\t1")]
    spans = spark.createDataFrame([(1, "r", 0, 2), (2, "r", 3, 8), (3, "r", 11, 14), (4, "r", 0, 99), (5, "u", 0, 3), (6, "r", 0, 2), (7, "x", 0, 1)], "id int, revision string, span_start long, span_end long")
    assert sorted((x.id, x.line, x.text) for x in reads.show_spans(b, spans).collect()) == [(1, 1, "ok"), (3, 3, "é"), (5, 1, "é"), (6, 1, "ok")]
