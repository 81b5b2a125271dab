import random

import pytest

from srcatlas.operators import hierarchy as H


def brute(parents):
    out = {}
    for x in parents:
        path, seen, y = [], set(), x
        while y is not None and y not in seen:
            seen.add(y)
            path.append(y)
            y = parents[y] if parents[y] in parents else None
        out[x] = None if y is not None else path[::-1]
    return out


def forest(n, seed, chain=0.7):
    rng = random.Random(seed)
    p = {}
    for i in range(n):
        p[i] = None if i == 0 or rng.random() < 0.02 else (i - 1 if rng.random() < chain else rng.randrange(i))
    for i in rng.sample(range(n), n // 50):
        p[i] = rng.randrange(n)  # may close cycles
    p[n] = n
    p[n + 1] = 10**9  # a parent that is no node
    return p


@pytest.mark.parametrize("task_rows,chain", [(10**6, 0.7), (150, 0.9), (40, 0.0)])
def test_matches_brute_force(spark, task_rows, chain):
    p = forest(900, 3, chain)
    rows = [(i, q, "x") for i, q in p.items()]
    random.Random(1).shuffle(rows)
    links = spark.createDataFrame([*rows, (None, 5, "y")], "id long, parent long, depth string")
    want = brute(p)
    got = {r.id: r for r in H.hierarchy(links, task_rows=task_rows).collect()}
    assert set(got) == set(p)
    for i, path in want.items():
        r = got[i]
        assert r.cyclic == (path is None)
        assert (r.path, r.root, r.depth) == ((path, path[0], len(path) - 1) if path else (None, None, None))


def test_descendants_and_sizes(spark):
    links = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "r"), ("x", "y"), ("y", "x"), ("z", "x"), ("b", "a")], "id string, parent string")
    h = H.hierarchy(links)
    assert {(r.ancestor, r.descendant, r.distance) for r in H.descendants(h).collect()} == {("r", "a", 1), ("r", "b", 2), ("r", "c", 1), ("a", "b", 1)}
    assert {(r.id, r.descendants, r.height) for r in H.subtree_sizes(h).collect()} == {("r", 3, 2), ("a", 1, 1), ("b", 0, 0), ("c", 0, 0)}
    one = H.descendants(h, spark.createDataFrame([("a",)], "id string"))
    assert [(r.ancestor, r.descendant) for r in one.collect()] == [("a", "b")]
    assert {r.id for r in h.where("cyclic").collect()} == {"x", "y", "z"}
    assert H.hierarchy(links.limit(0)).count() == 0


def test_commits(spark):
    o = ["%040x" % i for i in range(1, 9)]
    big = "ab" * 32
    t = ["2024-01-0%d 00:00:00" % i for i in range(1, 9)]
    rows = [
        ("m", o[0], None, t[0]), ("m", o[1], " " + o[0].upper() + "\n", t[1]), ("m", o[2], o[1], t[2]), ("m", o[2], o[2], t[1]), ("m", o[2], o[1], t[2]), ("m", o[3], "0" * 40, t[3]), ("m", o[4], "", None),
        ("m", o[5], o[6], t[4]), ("m", o[6], o[5], t[5]), (None, big, o[5], t[6]), ("m", o[7], "f" * 40, t[7]), ("m", None, o[0], t[0]),
    ]
    c = spark.createDataFrame(rows, "member string, oid string, parent string, observed string").selectExpr("member", "oid", "parent", "timestamp(observed) AS observed_at", "0 AS depth")
    got = {r.oid: (r.depth, r.cyclic) for r in H.commit_hierarchy(c).collect()}
    assert got == {o[0]: (0, False), o[1]: (1, False), o[2]: (2, False), o[3]: (0, False), o[4]: (0, False), o[5]: (None, True), o[6]: (None, True), big: (None, True), o[7]: (0, False)}


def test_commit_subtrees_over_several_levels(spark):
    p = {i: q for i, q in forest(700, 9, 0.9).items() if i <= 700}
    oid = lambda i: None if i is None else "%040x" % (i + 1)
    rows = [("m%d" % (i % 2), oid(i), oid(q), i) for i, q in p.items()]
    c = spark.createDataFrame(rows, "member string, oid string, parent string, t long").selectExpr("member", "oid", "parent", "timestamp_seconds(t) AS observed_at")
    want = {}
    for path in filter(None, brute(p).values()):
        for k, x in enumerate(path):
            n, h = want.get(oid(x), (-1, 0))
            want[oid(x)] = (n + 1, max(h, len(path) - 1 - k))
    for task_rows in (10**6, 120):
        assert {r.oid: (r.descendants, r.height) for r in H.commit_subtrees(c, task_rows).collect()} == want


def test_commit_descendants_hold_them_all(spark):
    p = {i: q for i, q in forest(700, 9, 0.9).items() if i <= 700}
    oid = lambda i: None if i is None else "%040x" % (i + 1)
    rows = [("m%d" % (i % 2), oid(i), oid(q), i) for i, q in p.items()]
    c = spark.createDataFrame(rows, "member string, oid string, parent string, t long").selectExpr("member", "oid", "parent", "timestamp_seconds(t) AS observed_at")
    want = {(oid(x), oid(path[-1])) for path in filter(None, brute(p).values()) for x in path[:-1]}
    for task_rows in (10**6, 120, 40):
        at = {r.oid: r for r in H.commit_descendants(c, task_rows).collect()}
        place = {(r.root, r.place): r.oid for r in at.values()}
        assert len(place) == len(at) == sum(x is not None for x in brute(p).values())
        assert {(r.oid, place[r.root, k]) for r in at.values() for k in range(r.place + 1, r.last + 1)} == want


def test_depths_over_several_levels(spark):
    p = forest(3000, 5, 0.97)
    got = {r.id: r.depth for r in H.hierarchy(spark.createDataFrame(list(p.items()), "id long, parent long"), with_path=False, task_rows=40).collect()}
    assert got == {i: len(path) - 1 if path else None for i, path in brute(p).items()}


def test_descendants_query_matches_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sql = entry.oracle_sql()["p6_descendants"].replace("FROM commits", f"FROM '{small}/commits.parquet'")
    want = sorted(tuple(r) for r in duckdb.sql(sql).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["p6_descendants"](spark, small).collect()) == want
