import json

import pytest

from srcatlas.operators import targets


def test_select_target():
    find = lambda n: {"one": [{"id": 1}], "two": [{"id": 1}, {"id": 2}]}.get(n, [])
    assert targets.select_target("abc:3", find)["kind"] == "handle" and targets.select_target("path:src/a.rs", find)["value"] == "src/a.rs"
    assert targets.select_target("sym:one", find)["value"] == {"id": 1} and len(targets.select_target("sym:two", find)["candidates"]) == 2
    with pytest.raises(KeyError):
        targets.select_target("sym:none", find)
    with pytest.raises(ValueError):
        targets.select_target("what", find)


def test_member_config():
    c = targets.member_config('[workspace]\nname = "w"\n[members.a]\npath = "/x/a/"\n[members.b]\npath = "/x/b"\n')
    assert c["order"] == ["a", "b"] and c["members"]["a"] == "/x/a"
    for bad in ("", '[members.a]\npath = "/x"\n[members.b]\npath = "/x/b"\n', '[workspace]\nmembers = ["z"]\n[members.a]\npath = "/x"\n'):
        with pytest.raises(ValueError):
            targets.member_config(bad)


def test_symbol_history_and_cache(spark):
    v = lambda s: spark.createDataFrame([(1, "a.rs", bytearray(s.encode()))], "file long, path string, bytes binary")
    a, b, c = "fn f() { 1 }\nfn g() { 2 }\n", "fn f() { 1 }\nfn g() { 3 }\n", "fn f() { 1 }\n"
    got = {(r.step, r.state) for r in targets.symbol_history([v(b), v(a), v(c)], "function/g").collect()}
    assert got == {(0, "modified"), (1, "added")}
    w = spark.createDataFrame([("1", "2"), ("2", "3")], "before string, after string")
    cache = spark.createDataFrame([("1", "2", "old")], "before string, after string, change string")
    all_, fresh = targets.cached_compare(w, cache, lambda p: p.selectExpr("before", "after", "'new' AS change"))
    assert {(r.before, r.change) for r in all_.collect()} == {("1", "old"), ("2", "new")} and fresh.count() == 1


def test_reextract_and_items():
    d = targets.reextract("a.rs", b"fn f() {}\nmod m {\n  fn f() {}\n}\n", "f", 20)
    assert d["container"] == "m" and d["freshness"] == "unpublished"
    with pytest.raises(KeyError):
        targets.reextract("a.rs", b"", "f", 0)
    idx = json.dumps({"paths": {"1": {"path": ["std", "vec", "Vec"], "kind": "struct"}, "2": {"path": ["std", "fmt"], "kind": "module"}}})
    assert [x["id"] for x in targets.documented_items(idx, "Vec$")] == ["1"]


def test_a_body_is_extracted_once_for_all_its_names(monkeypatch):
    body, calls, real = b"struct A { x: u8 }\nmod m { struct B; struct A; }\nmod n { struct A; }\n", [], targets.extract
    monkeypatch.setattr(targets, "extract", lambda *a: calls.append(a) or real(*a))
    wanted = [(n, near) for n in ("A", "B") for near in range(0, len(body) + 9)]
    got = targets.reextract_all("a.rs", body, wanted)
    assert len(calls) == 1 and {d["freshness"] for d in got} == {"unpublished"}
    defs = real("a.rs", body)["definitions"]
    for (name, near), d in zip(wanted, got):
        assert d["start"] == min((abs(x["start"] - near), x["start"]) for x in defs if x["name"] == name)[1]
    with pytest.raises(KeyError):
        targets.reextract_all("a.rs", body, [("A", 0), ("C", 0)])
