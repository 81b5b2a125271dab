"""Core operators on small hand-made inputs."""

import hashlib
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from srcatlas.functions import paths as FP
from srcatlas.functions import text as FT
from srcatlas.operators import corpus, evaluate, extraction, federation, filters, fusion, history, journal, lanes, navigation, reads, resolution, vectors


def test_query_text():
    q = filters.parse_query("item  slot lang:TS -file:./a%2fb file:src kind:class")
    assert (q.text, q.language, q.kind, q.includes, q.excludes) == ("item slot", "typescript", "class", ["src"], ["a%2Fb"])
    assert filters.parse_query("sym:Foo").exact and filters.parse_query("re: a b").regex
    for bad in ("sym:", "re:", "sym:re:x", "lang:klingon x"):
        with pytest.raises(ValueError):
            filters.parse_query(bad)
    assert lanes.concept('"a b"')["any"] == [] and lanes.concept("fooBar")["identifier"] == "fooBar" and lanes.concept("foo bar")["all"] == ["foo", "bar"]


def test_paths(spark):
    raw = "a %:@é\x01~".encode()
    assert FP.encode_path(raw) == "a%20%25%3A%40%C3%A9%01~" and FP.decode_path(FP.encode_path(raw)) == raw
    names = ["tests/a.rs", "src/test/x/a.rs", "src/test/src/a.rs", "a/test.rs", "a/x_tests.rs", "a/b.test.ts", "a/b_test.go", "a/test_b.py", "a/b_spec.rb", "contest/a.rs", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(FP.is_test_path(F.col("p"))).collect()]
    assert got == [True, True, False, False, True, True, True, True, True, False, None]
    exp = spark.createDataFrame([("fooBarHTTPServer2Go_x",)], "n string").select(FT.expand_identifiers(F.col("n"))).first()[0]
    assert exp == "foo bar http server2 go x"


def test_line_of_bytes(spark):
    data = b"a\n\xff\x0a\n\xa0b"
    df = spark.createDataFrame([(bytearray(data), i) for i in range(len(data))], "b binary, i int")
    got = [r[0] for r in df.select(FT.line_of(F.col("b"), F.col("i"))).collect()]
    assert got == [data[:i].count(b"\n") + 1 for i in range(len(data))]


def test_filters_on_frames(spark):
    f = spark.createDataFrame([("src/ring/a.rs", "rust"), ("lib/src/b.ts", "TS"), ("x/ring.rs", None), (None, "rust")], "path string, language string")
    assert filters.anchored(f, "src") and not filters.anchored(f, "ring")
    assert {r.path for r in filters.filter_paths(f, ["ring"], []).collect()} == {"src/ring/a.rs", "x/ring.rs"}
    assert {r.path for r in filters.filter_paths(f, ["src"], []).collect()} == {"src/ring/a.rs"}
    assert filters.resolve_single_file(f, "ring.rs") == "x/ring.rs" and filters.resolve_single_file(f, "nope") is None
    assert {r.path for r in filters.apply(f, filters.parse_query("lang:typescript")).collect()} == {"lib/src/b.ts"}


def test_exclusion_ladder_and_dedup(spark):
    rows = [("a", b"x", 1), ("b", b"a\0b", 3), ("c", None, 4), ("d", b"x", 3 << 20), ("e", b"x", None), ("f", b"\x10\x01", 2)]
    df = spark.createDataFrame([(p, bytearray(b) if b is not None else None, n) for p, b, n in rows], "path string, bytes binary, length long")
    got = {r.path: r.status for r in corpus.read_status(df).collect()}
    assert got == {"a": "read", "b": "binary_excluded", "c": "read_error", "d": "resource_excluded", "e": "metadata_error", "f": "read"}
    assert corpus.content_dedup(df).count() == 3
    files = df.selectExpr("path", "'ok' AS status", "length AS bytes", "path AS revision")
    a, b = (corpus.scan_fingerprint(x).first().fingerprint for x in (files, files.repartition(5)))
    assert a == b != corpus.scan_fingerprint(files.where("path <> 'a'")).first().fingerprint


def test_regions_cover_a_body():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(0, 20000)
        data = bytes(rng.choice(b"ab\n\xc3\xa9") for _ in range(n))
        spans = [(a, a + rng.randrange(1, 6000), i) for i, a in enumerate(rng.sample(range(max(1, n)), min(20, max(1, n))))]
        r = corpus.regions_of(data, spans)
        assert b"".join(data[a:b] for a, b, _ in r) == data and all(0 < b - a <= corpus.REGION for a, b, _ in r)
    assert corpus.regions_of(b"x" * 10, [(0, 5, 1), (1, 3, 2)]) == [(0, 5, 1), (5, 10, None)]


def test_insert_facts(spark):
    f = spark.createDataFrame([(3, [("f", "function", 0, 9), ("g", "function", 9, 12)], [(0, 1, "call"), (None, 1, "call"), (1, None, "call")])], "file_id long, definitions array<struct<name:string,kind:string,start:long,end:long>>, edges array<struct<source:int,target:int,kind:string>>")
    d, e = corpus.insert_facts(f)
    assert {(r.id, r.name) for r in d.collect()} == {(300000, "f"), (300001, "g")}
    assert {(r.source, r.target) for r in e.collect()} == {(300000, 300001), (300001, None)}


def test_cached_facts(spark):
    w = spark.createDataFrame([("r1", "g", 1), ("r2", "g", 1), ("r3", "g", 1)], "revision string, grammar string, version int")
    c = spark.createDataFrame([("r1", "g", 1, "complete"), ("r2", "g", 1, "cancelled")], "revision string, grammar string, version int, status string")
    hit, miss = corpus.cached_facts(w, c)
    assert {r.revision for r in hit.collect()} == {"r1"} and {r.revision for r in miss.collect()} == {"r2", "r3"}


REG = "id long, path string, name string, body string"


def test_lanes_and_fusion(spark):
    r = spark.createDataFrame([(1, "a/x.md", "ring", "slow cache query slow"), (2, "a/x.md", "", "cache"), (3, "b/cache.md", "cache", "nothing"), (4, "c", None, None), (5, "d", "", "")], REG)
    got = lanes.any_terms(r, ["cache", "slow"]).collect()
    assert [x.path for x in got] == ["a/x.md", "b/cache.md"] and [x.rank for x in got] == [1, 2]
    assert [x.id for x in lanes.any_terms(r, ["cache", "slow"], need_all=True).collect()] == [1]
    p = lanes.phrase(spark.createDataFrame([(1, "p", "", "a a a b"), (2, "q", "", "b a")], REG), ["a", "a"]).collect()
    assert [(x.path, x.score) for x in p] == [("p", 2.0)]
    assert lanes.any_terms(r, []).count() == 0
    assert [(x.path, x.score) for x in lanes.filename(r, ["cache"]).collect()] == [("b/cache.md", 3)]
    s = fusion.search(r, "slow cache").collect()
    assert s[0].path in ("a/x.md", "b/cache.md") and [x.rank for x in s] == list(range(1, len(s) + 1))
    hits = spark.createDataFrame([(0, "x", 1, 2.0, 1.0, 0), (1, "x", 2, 1.0, 0.7, 0), (1, "y", 1, 1.0, 1.0, 0)], "lane_no int, path string, rank int, weight double, prior double, tier int")
    f = {x.path: x.score for x in fusion.fuse(hits).collect()}
    assert f == {"x": round(2 / 61 + 0.7 / 62, 9), "y": round(1 / 61, 9)}
    rr = fusion.rerank(fusion.ranked(fusion.fuse(hits)).withColumn("body", F.col("path")), lambda b: b.map({"y": 5.0, "x": 1.0}).astype(float)).orderBy("final_rank").collect()
    assert [x.path for x in rr] == ["y", "x"]
    sn = fusion.snippets(spark.createDataFrame([(1, "", "", "// ring\nlet ring = 1\nx")], REG), ["ring"]).first()
    assert (sn.line, sn.snippet) == (2, "let ring = 1")


def test_lane_occurrence_and_regex(spark):
    reg = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 10, 20), (3, 2, 0, 5)], "region_id long, file_id long, span_start long, span_end long")
    occ = spark.createDataFrame([(1, "f", 2, 3, "import"), (1, "f", 12, 13, "call"), (2, "f", 1, 2, "call"), (2, "g", 1, 2, "call")], "file_id long, name string, span_start long, span_end long, role string")
    assert [(r.file_id, r.region_id, r.uses) for r in lanes.occurrence(reg, occ, "f").collect()] == [(1, 2, 2), (2, 3, 1)]
    t = spark.createDataFrame([(1, "a\nfn x\nb"), (2, None)], "id long, body string")
    assert [(r.id, r.line) for r in lanes.regex_lines(t, "^fn").collect()] == [(1, 2)]


DEF = "id long, file_id long, path string, name string, kind string, container string, span_start long, span_end long"


def test_navigation(spark):
    d = spark.createDataFrame(
        [(1, 1, "src/a-b/x.rs", "get", "method", "impl::Safe", 5, 9), (2, 1, "src/a-b/x.rs", "Safe", "class", None, 0, 20), (3, 2, "tests/x.rs", "get", "function", None, 0, 4), (4, 3, "lib/y.rs", "get", "import", None, 0, 4), (5, 3, "lib/y.rs", "get", "function", None, 9, 14)], DEF
    )
    assert [r.id for r in navigation.symbols(d, "get", "lib").orderBy("rank").collect()] == [5, 1, 3, 4]
    assert [(r.id, r.tier) for r in navigation.qualified(d, ["Safe"], "get").collect()] == [(1, 0)]
    assert [(r.id, r.tier) for r in navigation.qualified(d, ["a_b", "Safe"], "get").collect()] == [(1, 1)]
    assert navigation.qualified(d, ["Nope"], "get").count() == 0
    assert navigation.container_scopes("impl Show for Vec<T>") == [["Vec"], ["Show"]] and navigation.container_scopes(None) == []
    e = spark.createDataFrame([(1, 2, "calls"), (3, 1, "calls"), (3, None, "calls")], "source long, target long, kind string")
    hits = spark.createDataFrame([(9, 1, 6, 7)], "id long, file_id long, span_start long, span_end long")
    assert {(r.source, r.target) for r in navigation.context(hits, d, e).collect()} == {(1, 2), (3, 1)}
    assert {(r.id, r.hops) for r in navigation.walk(d.where("id = 3").select("id"), e).collect()} == {(3, 0), (1, 1), (2, 2)}
    trail = navigation.follow_imports(d.where("id = 3").select("id"), spark.createDataFrame([(3, 4), (4, 3), (4, 5)], "id long, target long"))
    assert {(r.hop, r.id) for r in trail.collect()} == {(0, 3), (1, 4), (2, 5)}
    o = d.where("id IN (3)").select("id", "name", F.lit("rust").alias("language"), F.lit(None).cast("long").alias("target"))
    c = navigation.resolve_names(o, d.select("id", "name", F.lit("rust").alias("language"))).first()
    assert c.candidates == [1, 3, 4, 5]
    names = navigation.directory_outline(spark.createDataFrame([(1, i, "n" * 20 + str(i), "function", None, i) for i in range(6)], "file_id long, id long, name string, kind string, container string, span_start long")).first().names
    assert names.count(", ") == 3 and names.endswith(" +2")
    site = spark.createDataFrame([(1, "f", "p", 3, "call", None), (2, "f", "p", 3, "call", None)], "id long, name string, path string, line long, role string, target long")
    assert navigation.collapse_references(site).first().repeats == 2 and navigation.reference_summary(site).first().sites == 2


def test_tree_compare(spark):
    t = "path string, oid string, mode string"
    old = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", "3", "m"), ("d", "3", "m"), ("e", "5", "m"), ("f", "6", "m"), ("g", None, "m")], t)
    new = spark.createDataFrame([("a", "1", "m"), ("b", "9", "m"), ("x", "3", "m"), ("y", "5", "m"), ("z", "6", "n"), ("h", None, "m")], t)
    got = {(r.change, r.old_path, r.new_path) for r in history.tree_compare(old, new).collect()}
    assert got == {("modified", "b", "b"), ("renamed_exact_blob", "e", "y"), ("deleted", "c", None), ("deleted", "d", None), ("added", None, "x"), ("deleted", "f", None), ("added", None, "z"), ("deleted", "g", None), ("added", None, "h")}
    assert history.tree_compare(old.limit(0), new.limit(0)).count() == 0
    steps = history.history_of("y", [new, old, old.limit(0)])
    assert [(s["step"], s["change"]) for s in steps] == [(0, "renamed_exact_blob"), (1, "added")]


def test_line_diff_reconstructs():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz"))
        old, new = "\n".join(a).encode(), "\n".join(b).encode()
        la, lb, out, at = old.split(b"\n"), new.split(b"\n"), [], 0
        for x0, x1, y0, y1 in history.diff_lines(old, new):
            out += la[at:x0] + lb[y0:y1]
            at = x1
        assert out + la[at:] == lb
    assert history.diff_lines(b"a\nb", b"a\nb") == []


def test_correspondence_and_blame(spark):
    s = "id long, file long, key string, digest string"
    old = spark.createDataFrame([(1, 1, "f", "d1"), (2, 1, "g", "d2"), (3, 1, "h", "d3"), (4, 1, "i", "d4")], s)
    new = spark.createDataFrame([(5, 1, "f", "d1"), (6, 1, "g", "dx"), (7, 1, "k", "d3"), (8, 1, "l", "d9")], s)
    got = {(r.state, r.old_id, r.new_id) for r in history.correspond(old, new).collect()}
    assert got == {("unchanged", 1, 5), ("modified", 2, 6), ("moved", 3, 7), ("deleted", 4, None), ("added", None, 8)}
    b = spark.createDataFrame([("p", i, o) for i, o in enumerate("aabba", 1)] + [("p", 9, "a")], "path string, line int, oid string")
    assert {(r.oid, r.first_line, r.last_line) for r in history.blame_runs(b, ["path"]).collect()} == {("a", 1, 2), ("b", 3, 4), ("a", 5, 5), ("a", 9, 9)}


def test_change_feed_and_sessions(spark):
    s = "path string, revision string, status string, bytes long"
    old = spark.createDataFrame([("a", "1", "ok", 1), ("b", "2", "ok", 1), ("c", None, "x", 1), ("d", "4", "ok", 1), ("e", "5", "ok", 1)], s)
    new = spark.createDataFrame([("a", "1", "ok", 1), ("b", "3", "ok", 1), ("d", None, "x", 1), ("f", "5", "ok", 1)], s)
    assert {(r.path, r.kind) for r in history.change_feed(old, new).collect()} == {("b", "modified"), ("c", "ignored_or_excluded"), ("d", "coverage_changed"), ("e", "deleted"), ("f", "added")}
    assert {(r.path, r.kind) for r in journal.session_changes(old, new).collect()} == {("b", "modified"), ("c", "ignored_or_excluded"), ("d", "coverage_change"), ("f", "renamed")}
    w = spark.createDataFrame([(i, 100, i != 2) for i in range(1, 6)], "generation int, rows int, complete boolean")
    assert {r.generation for r in history.retained(w, 10, 250).collect()} == {4, 5}
    assert history.observations_since(w, w, 2, 5)[1] and not history.observations_since(w, w, 1, 5)[1] and not history.observations_since(w, w, 4, 7)[1]


def test_vectors(spark):
    assert vectors.plan_batches([4096, 1024, 1024, 1024, 1024]) == [(0, 2), (2, 5)] and vectors.plan_batches([]) == [] and vectors.plan_batches([99999, 1]) == [(0, 1), (1, 2)]
    lens = [random.Random(1).randrange(1, 5000) for _ in range(60)]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(lens)], "g int, nth long, tokens long")
    got = [r.batch for r in vectors.batches(df, "g").orderBy("nth").collect()]
    assert got == [k for k, (a, b) in enumerate(vectors.plan_batches(lens)) for _ in range(b - a)]
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0]), ("e", None), ("f", [0.6, 0.8])], "key string, vector array<float>")
    assert {r.key: [round(x, 6) for x in r.vector] for r in vectors.normalise(v, 2).collect()} == {"a": [0.6, 0.8], "f": [0.6, 0.8]}
    assert {r.key: r.state for r in vectors.validity(v, 2).collect()} == {"a": "norm", "b": "norm", "c": "non_finite", "d": "length", "e": "missing", "f": "ok"}
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, touched long")
    assert [r.key for r in vectors.put(c, spark.createDataFrame([("a", 9)], "key string, touched long"), 2).collect()] == ["a", "c"]
    assert vectors.content_key("a", "m", "x", 1, 2) != vectors.content_key("ma", "", "x", 1, 2)
    adm = vectors.Admission(1, 2, 10)
    assert adm.try_admit(2, 5) and not adm.try_admit(1, 1) and not adm.try_admit(3, 0)
    q = vectors.BoundedQueue(2)
    assert [q.record(i) for i in range(3)] == [True, True, False] and q.dropped == 1
    with pytest.raises(ValueError):
        vectors.check_rerank("q", ["x"] * 33)
    t = spark.createDataFrame([("r1", i, False) for i in range(4)] + [("r2", 9, False), ("r1", 10, True)], "root string, arrived long, background boolean")
    assert [r.arrived for r in vectors.fair_turns(t).orderBy("slot").collect()] == [0, 9, 1, 10, 2, 3]


def test_journal(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00.000"), ("u", "2024-01-01 00:00:00.050"), ("u", "2024-01-01 00:00:00.120"), ("u", "2024-01-01 00:00:01.000"), ("u", None)], "u string, t string").selectExpr("u", "timestamp(t) AS ts")
    assert sorted(r.events for r in journal.debounce(e, ["u"]).collect()) == [1, 3]
    a = spark.createDataFrame([(1, "server", None, None), (1, "delivery", True, 5), (2, "server", None, None), (2, "delivery", False, 9), (3, "dropped", None, None)], "request_id int, kind string, complete boolean, tokens long")
    r = {x.request_id: (x.served, x.delivered, x.tokens, x.lost) for x in journal.audit(a).collect()}
    assert r == {1: (1, 1, 5, 0), 2: (1, 0, 0, 0), 3: (0, 0, 0, 1)} and not journal.audit_totals(journal.audit(a)).first().complete_window
    assert journal.receipt(5, 5, True)["complete"] and journal.receipt(5, 3, True)["failure"] == "write" and journal.receipt(5, 5, False)["failure"] == "flush"
    rec = spark.createDataFrame([("s", 1, "search", 0, 5.0, "ok", "a"), ("s", 2, "search", 3, 7.0, "ok", "a"), ("s", 3, "show", None, 1.0, "error", None)], "session string, seq int, verb string, hits int, elapsed_ms double, status string, text string")
    x = journal.agent_sessions(rec).first()
    assert (x.calls, x.searches, x.errors, x.empties, x.repeats, x.followed) == (3, 2, 1, 1, 1, 2)


def test_federation(spark):
    assert federation.scope(["in:b", "x"], ["a", "b"], "a") == (["b"], ["x"]) and federation.scope(["x"], ["a", "b"], "a")[0] == ["a"]
    with pytest.raises(ValueError):
        federation.scope(["in:b", "ws:all"], ["a", "b"], "a")
    h = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("c", 3)], "member string, rank int")
    assert [(r.member, r.rank) for r in federation.merge(h, "c").orderBy("place").collect()] == [("c", 1), ("a", 1), ("b", 1), ("c", 2), ("a", 2), ("c", 3)]
    assert federation.widen(h, "a").count() == 2 and federation.widen(h, "zz").count() == 6


def test_resolution(spark):
    assert resolution.jsonc('{"a": "//x", /* c */ "b": [1,], // d\n}') == {"a": "//x", "b": [1]}
    assert resolution.normal_path("a/../../b") is None and "src/x.ts" in resolution.module_candidates("src/a.ts", "./x", "typescript")
    assert "base/lib/q.ts" in resolution.module_candidates("src/a.ts", "@q", "typescript", {"compilerOptions": {"baseUrl": ".", "paths": {"@*": ["lib/*"]}}}, "base")
    imp = spark.createDataFrame([(1, "src/a.ts", "./x", "typescript"), (2, "src/a.ts", "react", "typescript"), (3, "src/a.ts", "@q", "typescript")], "id long, path string, spelled string, language string")
    files = spark.createDataFrame([("src/x.ts",), ("lib/q.ts",)], "path string")
    conf = spark.createDataFrame([("", '{"compilerOptions": {"paths": {"@*": ["lib/*"]}}} // c')], "directory string, config string")
    got = {r.id: (r.candidates, r.target) for r in resolution.resolve_modules(imp, files, conf).collect()}
    assert got == {1: (["src/x.ts"], "src/x.ts"), 3: (["lib/q.ts"], None)}
    reg = spark.createDataFrame([("B", "x", 1), ("B", "y", 2), ("B", "z", 2), ("B", "w", 3)], "base string, implementation string, priority long")
    e, i = resolution.ordered_chain(reg)
    assert {(r.source, r.target, r.kind) for r in e.collect()} == {("x", "B", "base"), ("y", "x", "previous"), ("z", "x", "previous"), ("y", "z", "tie"), ("z", "y", "tie"), ("w", "y", "previous"), ("w", "z", "previous")}
    for n, issues in ((63, 0), (64, 1)):
        big = spark.createDataFrame([("B", f"c{k}", k) for k in range(n)], "base string, implementation string, priority long")
        e, i = resolution.ordered_chain(big)
        assert i.count() == issues and (e.count() == 0) == bool(issues)
    p = spark.createDataFrame([("A", "x", 1, True), ("A", "y", -1, True), ("B", "z", 1, True), ("C", "c", 1, True), ("D", "q", 1, False), ("E", "r", None, True)], "base string, implementation string, priority long, active boolean")
    ok, bad = resolution.prepare_chains(p)
    assert {r.base for r in ok.collect()} == {"B"} and {(r.base, r.issue) for r in bad.collect()} == {("A", "negative_order"), ("C", "self"), ("E", "unknown_order")}
    xml = b'<x><extension from_class="A" to_class="B" active="1" execute_order="10"/></x>'
    assert resolution.parse_extensions(xml) == [{"from_class": "A", "to_class": "B", "active": True, "execute_order": 10}]
    assert resolution.parse_extensions(xml.replace(b'active="1"', b'active="2"')) == [] and resolution.parse_extensions(b"<x>") == []
    req = resolution.parse_requirements('{"a": {"require": {"z": 1}}, "require": {"p": [1], "q": {"p": 2}, "p": 3}}')
    assert [(r["key"], r["repeated"]) for r in req][:1] == [("z", False)] or [(r["key"], r["repeated"]) for r in req] == [("p", False), ("q", False), ("p", True)]
    assert resolution.parse_requirements("{") == []
    with pytest.raises(RuntimeError):
        resolution.charge(199_999, 2)
    calls = spark.createDataFrame([(1, 10, "m"), (2, 10, "n")], "id long, class long, name string")
    edges = spark.createDataFrame([(10, 11), (11, 12), (12, 10)], "source long, target long")
    meth = spark.createDataFrame([(7, 12, "m", "public", False), (8, 11, "n", "private", False), (9, 12, "n", "public", False)], "id long, class long, name string, visibility string, abstract boolean")
    assert [(r.call, r.method, r.hops) for r in resolution.parent_method(calls, edges, meth).collect()] == [(1, 7, 2)]


def test_evaluation(spark):
    lab = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "task string, path string")
    hit = spark.createDataFrame([("t", "a", 1), ("t", "x", 2), ("t", "b", 7)], "task string, path string, rank int")
    r = {x.task: (x.recall_5, x.recall_10, x.miss) for x in evaluate.recall(lab, hit).collect()}
    assert r == {"t": (0.5, 1.0, False), "u": (0.0, 0.0, True)}
    sp = spark.createDataFrame([(1, 0, 5), (1, 5, 10), (2, 0, 4), (2, 5, 10), (3, 2, 20)], "id int, start long, end long")
    la = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 3, 9), (4, 0, 1)], "id int, start long, end long")
    assert {x.id: x.covered for x in evaluate.span_coverage(la, sp).collect()} == {1: True, 2: False, 3: True, 4: False}
    u = evaluate.usage(spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 3, 4)], "g string, x int, y int"), "g", ["x", "y"])
    assert {x.g: (x.x, x.y, x.censored) for x in u.collect()} == {"a": (3, None, True), "b": (3, 4, False)}
    assert evaluate.classify_search("grep -rn 'fn foo' src") == "definition" and evaluate.classify_search("rg foo_bar") == "reference"
    assert evaluate.classify_search("rg 'fn |struct |impl'") == "outline" and evaluate.classify_search("rg -A5 foo") == "body" and evaluate.classify_search("ls") == "other" and evaluate.classify_search("rg 'two words'") == "text"


SOURCES = {
    "a.rs": "use crate::x::Y;\npub struct Safe { a: u32 }\nimpl Safe {\n    pub fn get(&self) -> u32 { helper(\"fn no() {}\") }\n}\nfn helper(s: &str) -> u32 { 1 }\n",
    "a.ts": "import { q } from './q';\nexport class A {\n  run(x: number): void { go(x); }\n}\nfunction go(a) { return a; }\n",
    "a.php": "<?php\nfinal class B extends C {\n  public function f() { return parent::f(); }\n}\n",
    "a.lua": "local function f(x)\n  if x then return g(x) end\nend\nfunction m.g() end\n",
    "a.cs": "using System;\npublic sealed class D {\n  public int F(int a) {\n    return G(a);\n  }\n}\n",
    "a.dm": "/datum/thing\n\tvar/x = 1\n\n/datum/thing/proc/go(a)\n\treturn run(a)\n",
}


def test_extraction(spark):
    got = {p: extraction.extract(p, s.encode()) for p, s in SOURCES.items()}
    names = lambda p: {(d["name"], d["kind"], d["container"]) for d in got[p]["definitions"]}
    assert {("Safe", "struct", None), ("get", "method", "Safe"), ("helper", "function", None)} <= names("a.rs")
    assert not any(d["name"] == "no" for d in got["a.rs"]["definitions"])
    assert {("A", "class", None), ("run", "method", "A"), ("go", "function", None)} <= names("a.ts")
    assert {("B", "class", None), ("f", "method", "B")} <= names("a.php") and {("f", "function", None)} <= names("a.lua") and ("F", "method", "D") in names("a.cs") and ("go", "proc", "datum/thing") in names("a.dm")
    assert got["a.ts"]["modules"][0]["spelled"] == "./q"
    call = [o for o in got["a.rs"]["occurrences"] if o["role"] == "call"]
    assert [c["name"] for c in call] == ["helper"] and got["a.rs"]["definitions"][call[0]["target"]]["name"] == "helper"
    assert extraction.extract("x.rs", b"\xff")["status"] == "invalid_encoding" and extraction.extract("x.md", b"")["status"] == "lexical_only"
    b = [{"id": 1, "name": "x", "start": 0, "end": 100, "visible": 0}, {"id": 2, "name": "x", "start": 10, "end": 50, "visible": 10}, {"id": 3, "name": "x", "start": 10, "end": 50, "visible": 30}, {"id": 4, "name": "x", "start": 10, "end": 50, "visible": 30}]
    assert extraction.resolve_scope(b, "x", 20) == (2, []) and extraction.resolve_scope(b, "x", 70) == (1, []) and extraction.resolve_scope(b, "x", 40) == (None, [3, 4])
    df = spark.createDataFrame([("r", p, bytearray(s.encode())) for p, s in SOURCES.items()] + [("n", None, None)], "revision string, path string, bytes binary")
    assert extraction.extract_all(df).where("fact = 'file'").count() == len(SOURCES)


def test_reads(spark, tmp_path):
    data = b"one\ntwo \xff\nthree\n"
    r = hashlib.sha256(data).hexdigest()
    assert reads.show(data, r, 4, len(data))["rows"] == [{"line": 2, "text": "two \\xff", "encoding": "escaped"}, {"line": 3, "text": "three", "encoding": "utf-8"}]
    with pytest.raises(reads.StaleSource):
        reads.show(data + b"x", r, 0, 1)
    assert reads.show(b"a\n" * 300, hashlib.sha256(b"a\n" * 300).hexdigest(), 0, 600)["next"] == 200
    (tmp_path / "f").write_bytes(b"x")
    os.symlink(tmp_path / "f", tmp_path / "l")
    assert reads.read_contained(str(tmp_path), "f") == b"x"
    for bad in ("../f", "/etc/passwd", "l", ""):
        with pytest.raises(ValueError):
            reads.read_contained(str(tmp_path), bad)
    hits = [{"path": f"p{i}", "name": "n" * 20, "snippet": "s" * 50} for i in range(20)]
    p = reads.page(hits, "set", 0, 20, 400, len)
    assert p["next"] == f"set@{len(p['hits'])}" and len(json.dumps(p, ensure_ascii=False)) <= 400 and "snippet" not in p["hits"][0]
    assert reads.page(hits, "set", 0, 5, 10_000, len)["hits"][4]["handle"] == "set:5" and reads.parse_cursor("a@3") == ("a", 3) and reads.parse_handle("a:1") == ("a", 1)
    with pytest.raises(ValueError):
        reads.parse_handle("a:0")
    b = spark.createDataFrame([("r", bytearray("é\nb\nc\n".encode()))], "revision string, bytes binary")
    s = spark.createDataFrame([(1, "r", 3, 7)], "id int, revision string, span_start long, span_end long")
    assert [(x.line, x.text) for x in reads.show_spans(b, s).orderBy("line").collect()] == [(2, "b"), (3, "c")]
    j = spark.createDataFrame([("p", 1, 2, "n" * 200)], "path string, start_line int, end_line int, name string").select(reads.compact(spark.createDataFrame([("p", 1, 2, "n")], "path string, start_line int, end_line int, name string"))).first()[0]
    assert len(json.loads(j)["name"]) == 96
    sets = spark.createDataFrame([(f"s{i}", i, 10) for i in range(5)], "id string, created long, bytes long")
    assert {x.id for x in reads.evict(sets, 3, 25).collect()} == {"s4", "s3"}
    assert reads.retry("busy")[0] == 1 and reads.retry("other")[0] == 0


def test_tree_and_git_sources(spark, tmp_path):
    from srcatlas.sources import trees

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/out/\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a").write_text("x")
    for n, b in (("a.rs", b"fn"), ("b.log", b"x"), ("keep.log", b"x"), ("bin", b"\0"), ("ü n.rs", b"")):
        (tmp_path / "src" / n).write_bytes(b)
    trees.register(spark)
    got = {r.path: r.status for r in spark.read.format("srcatlas_tree").option("path", str(tmp_path)).load().collect()}
    assert got == {".gitignore": "read", "src/a.rs": "read", "src/keep.log": "read", "src/bin": "binary_excluded", "src/%C3%BC%20n.rs": "read"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src/a.rs")
    run("commit", "-qm", "one")
    run("mv", "src/a.rs", "src/c.rs")
    run("commit", "-qm", "two")
    log = spark.read.format("srcatlas_git").option("path", str(tmp_path)).load().orderBy("depth").collect()
    assert [r.summary for r in log] == ["two", "one"] and log[0].parent == log[1].oid and log[1].parent is None
    tree = lambda rev: spark.read.format("srcatlas_git").option("path", str(tmp_path)).option("what", "tree").option("revision", rev).load()
    assert [(r.change, r.old_path, r.new_path) for r in history.tree_compare(tree(log[1].oid), tree("HEAD")).collect()] == [("renamed_exact_blob", "src/a.rs", "src/c.rs")]


def test_generations_and_result_sets(spark, tmp_path):
    from srcatlas.sources.generations import Generations, ResultSets, Warming, seed_cache, unreferenced

    g = Generations(spark, str(tmp_path / "g"))
    with pytest.raises(Warming):
        g.snapshot().table("t")
    assert g.snapshot().table("t", "a int").count() == 0
    assert g.publish({"t": spark.range(3)}, "f1") == 1
    old = g.snapshot()
    assert g.publish({"t": spark.range(5)}, "f1") == 1 and g.publish({"t": spark.range(5)}, "f2") == 2
    assert old.table("t").count() == 3 and g.snapshot().table("t").count() == 5
    g.publish({"t": spark.range(1)}, "f3")
    g.prune(1)
    assert sorted(os.listdir(tmp_path / "g"))[0:1] != ["gen=1"] and g.snapshot().table("t").count() == 1
    rs = ResultSets(spark, str(tmp_path / "r"))
    sid = rs.save(spark.range(4).withColumnRenamed("id", "rank"), now=1000.0)
    assert rs.load(sid, now=1500.0).count() == 4
    for bad, when in ((sid, 1601.0), ("nope", 0.0)):
        with pytest.raises(KeyError):
            rs.load(bad, now=when)
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    assert seed_cache(a, spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int"), ["k"]).count() == 2
    c = spark.createDataFrame([("r1",), ("r2",)], "revision string")
    assert [r.revision for r in unreferenced(c, spark.createDataFrame([("r1",), (None,)], "revision string")).collect()] == ["r2"]


def test_streaming(spark, tmp_path):
    from srcatlas.streaming import feeds

    src = tmp_path / "in"
    ev = "u string, t string"
    rows = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:00")], [("a", "2024-01-01 01:00:00")], [("c", "2024-01-01 09:00:00")], [("c", "2024-01-01 10:00:00")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, ev).selectExpr("u", "timestamp(t) AS ts").coalesce(1).write.parquet(str(src / f"{i}"))
    read = lambda: spark.readStream.schema("u string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {(r.u, r.events) for r in drain(feeds.debounced(read(), "u", "5 seconds", "1 second"), "bursts")}
    assert {("a", 2), ("b", 1)} <= got
    gone = {r.u for r in drain(feeds.expiring(read(), "u", 600, "1 second"), "gone")}
    assert {"a", "b"} <= gone and len(gone) <= 3
    seen = []
    s = "path string, revision string, status string, bytes long"
    spark.createDataFrame([("x", "2", "ok", 1), ("y", "1", "ok", 1)], s).coalesce(1).write.parquet(str(tmp_path / "scan"))
    stream = spark.readStream.schema(s).parquet(str(tmp_path / "scan"))
    last = spark.createDataFrame([("x", "1", "ok", 1)], s)
    q = feeds.publication_feed(stream, lambda: last, lambda c, n: seen.extend((r.path, r.kind, n) for r in c.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(seen) == {("x", "modified", 0), ("y", "added", 0)}


def test_grades_take_every_line(spark, small):
    import __spark_entry__ as entry

    docs = {(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect() if r.text is not None}
    want = sum(len(t.split("\n")) for _, _, t in docs)
    got = entry.queries()["grade_task"](spark, small).collect()
    assert sum(r.verified + r.rejected for r in got) == want
