"""Extraction by family: names, kinds, containers, byte spans, scopes, relationships; damaged and empty sources."""

import re

import pyarrow as pa
import pytest

from srcatlas.operators import extraction
from srcatlas.operators.extraction import extract, extract_all
from srcatlas.plans import changes, stores


def kinds(x):
    return {(d["name"], d["kind"], d["container"]) for d in x["definitions"]}


def uses(x, name, role="read"):
    return [None if o["target"] is None else x["definitions"][o["target"]] for o in x["occurrences"] if o["name"] == name and o["role"] == role]


def spans_cut(source: bytes, x):
    for d in x["definitions"]:
        assert 0 <= d["start"] <= d["name_start"] < d["name_end"] <= len(source)
        cut = source[d["name_start"] : d["name_end"]].decode().lstrip("$")
        assert cut == d["name"].lstrip("$") or d["kind"] in ("import", "namespace", "impl")
    for o in x["occurrences"]:
        assert 0 <= o["start"] < o["end"] <= len(source)


def test_rust_items_and_scopes():
    s = "use a::{b, c as d};\n/// größe\npub(crate) struct Größe<T> { pub weite: T }\nenum Art { Eins, Zwei(u8) }\ntrait Flaeche: Form { fn groesse(&self) -> f64; }\nimpl<T> Flaeche for Größe<T> {\n    fn groesse(&self) -> f64 { let x = 1.0; rechne(x) }\n}\nfn rechne(x: f64) -> f64 { let g = |y| y * x; fn innen() -> f64 { x } if let Some(z) = neu() { z } else { g(x) } }\nmacro_rules! m { () => {} }\nconst ZAHL: u8 = 3;\n"
    x = extract("a.rs", s.encode())
    assert x["status"] == "recovered"
    assert {("Größe", "struct", None), ("weite", "field", "Größe"), ("Eins", "variant", "Art"), ("Flaeche", "trait", None), ("groesse", "method", "Flaeche"), ("groesse", "method", "Größe"), ("rechne", "function", None), ("m", "macro", None), ("ZAHL", "constant", None), ("b", "import", None), ("d", "import", None)} <= kinds(x)
    spans_cut(s.encode(), x)
    assert {(r["kind"], r["name"]) for r in x["relationships"]} == {("extends", "Form"), ("implements", "Flaeche")}
    assert uses(x, "rechne", "call")[0]["kind"] == "function" and uses(x, "y")[0]["kind"] == "parameter" and uses(x, "z")[0]["kind"] == "variable"
    seen = [d["kind"] if d else None for d in uses(x, "x")]
    # the inner function does not see the parameter of the outer one; the closure does
    assert seen.count(None) == 1 and "parameter" in seen and "variable" in seen
    d = next(d for d in x["definitions"] if d["name"] == "Größe" and d["kind"] == "struct")
    assert s.encode()[d["start"] : d["end"]].decode() == "pub(crate) struct Größe<T> { pub weite: T }"


def test_script_bindings():
    x = extract("a.ts", b"const n = 1; function f({ key: n = 2, ...rest }) { return n; }")
    assert uses(x, "n")[0]["kind"] == "parameter"
    # a later let hides the outer name before it can be used; var belongs to the function
    assert uses(extract("a.js", b"const n = 1; function f() { g(n); let n = 2; }"), "n") == [None]
    x = extract("a.js", b"const n = 1; function f() { if (a) { var n = 2; } return n; }")
    assert uses(x, "n")[0]["start"] > 20
    x = extract("a.js", b"load(); function load() {} app.load = function () {};")
    assert uses(x, "load", "call")[0]["kind"] == "function"
    s = "import d, { e as f } from './m.js';\nexport default class K extends Base implements I, J {\n  static s = 1\n  #p;\n  constructor(q) { super(q); }\n  async run(a, { b, c: [x] }) { for (const i of a) { this.go(i); } try { } catch (err) { log(err); } return a.map(v => v + x); }\n}\nenum E { A, B = 2 }\nconst g = require('./n');\nexport { h } from './o';\ntype T = { z: number };\n"
    x = extract("a.ts", s.encode())
    assert {("K", "class", None), ("s", "field", "K"), ("constructor", "constructor", "K"), ("run", "method", "K"), ("A", "variant", "E"), ("T", "type", None), ("f", "import", None)} <= kinds(x)
    assert [m["spelled"] for m in x["modules"]] == ["./m.js", "./n", "./o"]
    assert {(r["kind"], r["name"]) for r in x["relationships"]} == {("extends", "Base"), ("implements", "I"), ("implements", "J")}
    assert all(uses(x, n)[0] for n in ("i", "err", "v", "x"))
    spans_cut(s.encode(), x)


def test_csharp_members():
    s = "using System.Text;\nusing R = App.Runtime;\nnamespace App.Räume {\n  public sealed record Punkt(int X, int Y);\n  public partial class Haus : Bau, ITür {\n    private const int Max = 3; private int _z;\n    public event Action Auf;\n    public Haus(int z) { _z = z; var kopie = z; }\n    public int Zahl { get; set; } = 4;\n    public int Doppelt => _z * 2;\n    public T Baue<T>(T wert) where T : new() { foreach (var w in Alle()) { Nimm(w); } return wert; }\n  }\n  enum Art { Alt, Neu }\n}\n"
    x = extract("a.cs", s.encode())
    want = {("App.Räume", "namespace", None), ("Punkt", "record", "App.Räume"), ("X", "parameter", "Punkt"), ("Haus", "class", "App.Räume"), ("Max", "constant", "Haus"), ("_z", "field", "Haus"), ("Auf", "event", "Haus"), ("Haus", "constructor", "Haus"), ("Zahl", "property", "Haus"), ("Doppelt", "property", "Haus"), ("Baue", "method", "Haus"), ("Alt", "enum_member", "Art")}
    assert want <= kinds(x)
    spans_cut(s.encode(), x)
    assert {r["name"] for r in x["relationships"]} == {"Bau", "ITür"} and [m["spelled"] for m in x["modules"]] == ["System.Text", "App.Runtime"]
    assert uses(x, "w")[0]["kind"] == "local" and uses(x, "wert")[0]["kind"] == "parameter"


def test_php_names_and_hierarchy():
    s = "<p>class No {}</p>\n<?php\nnamespace App\\Läden;\nuse Lib\\Basis as B, Lib\\Tür;\nif (X) { class Bedingt {} }\nabstract class Laden extends B implements Tür, \\Zähler {\n  use Kasse;\n  const A = 1; protected ?string $name; case;\n  private function geheim() {}\n  abstract protected static function offen(Ware $w);\n  public function f($a) { $b = $a; $c = function ($d) use ($b) { return $b . $d; }; return parent::f($c); }\n}\nenum Art: string { case Neu = 'n'; }\n?>\n<b>class No2 {}</b>\n"
    x = extract("a.php", s.encode())
    assert {("App\\Läden", "namespace", None), ("Laden", "class", "App\\Läden"), ("A", "constant", "Laden"), ("name", "property", "Laden"), ("geheim", "method", "Laden"), ("Neu", "enum_case", "Art")} <= kinds(x)
    assert not any(d["name"].startswith("No") for d in x["definitions"])
    spans_cut(s.encode(), x)
    assert {(r["kind"], r["name"]) for r in x["relationships"]} == {("extends", "Lib\\Basis"), ("implements", "Lib\\Tür"), ("implements", "Zähler"), ("trait_use", "App\\Läden\\Kasse")}
    by = {d["name"]: d for d in x["definitions"]}
    assert (by["geheim"]["visibility"], by["offen"]["visibility"], by["offen"]["abstract"], by["f"]["visibility"]) == ("private", "protected", True, "public")
    assert by["Bedingt"]["conditional"] and not by["Laden"]["conditional"] and by["Laden"]["canonical"] == "App\\Läden\\Laden"
    assert uses(x, "$d")[0]["kind"] == "parameter" and uses(x, "$a")[0]["kind"] == "parameter"


def test_luau_blocks():
    s = b"local M = require(script.Parent.M)\nlocal function f(a: number, b)\n\tlocal c = if a then b else 0\n\tfor i, v in pairs(b) do print(i, v) end\n\tif c then return c end\n\treturn i\nend\nfunction M.go(x) return f(x, x) end\nfunction M:run() end\ntype P = { q: number }\nlocal x = x\n"
    x = extract("a.luau", s)
    assert {("f", "function", None), ("go", "function", "M"), ("run", "method", "M"), ("P", "type", None), ("M", "variable", None)} <= kinds(x)
    assert uses(x, "f", "call")[0]["kind"] == "function" and uses(x, "v")[0] is not None
    assert [d is not None for d in uses(x, "i")] == [True, False] and uses(x, "x")[-1] is None
    assert x["modules"][0]["spelled"] == "script.Parent.M"


def test_dreammaker_paths():
    s = b"#define HIT \"hit\"\n#include \"f.dm\"\n/datum/base/proc/go(a)\n\tif(a)\n\t\tvar/b = a\n\t\tuse(b)\n\tuse(b)\n/obj/kid\n\tparent_type = /datum/base\n\tvar/speed = 2\n\tgo(a)\n\t\tSEND_SIGNAL(src, HIT)\n\t\treturn ..()\n"
    x = extract("a.dm", s)
    assert {("HIT", "macro", None), ("go", "proc", "datum/base"), ("kid", "class", "obj"), ("go", "proc", "obj/kid"), ("speed", "constant", "obj/kid")} <= kinds(x)
    assert [d is not None for d in uses(x, "b")] == [True, False]
    parent = next(o for o in x["occurrences"] if o["role"] == "parent_call")
    assert parent["target"] is None and [x["definitions"][k]["container"] for k in parent["candidates"]] == ["datum/base"]
    assert {o["name"] for o in x["occurrences"] if o["role"] in ("signal", "include", "parent_type")} == {"HIT", "f.dm", "/datum/base"}
    assert {r["kind"] for r in x["relationships"]} == {"inheritance", "signal_call"}
    broken = extract("a.dm", b"/obj/real()\n\tvar/t = \"open\n/obj/fake()\n\"\n")
    assert broken["status"] == "recovered_incomplete" and not any(d["name"] == "fake" for d in broken["definitions"])


@pytest.mark.parametrize("path,text", [("a.rs", "fn f( { let x = 1; g(x)"), ("a.ts", "class A { m( { x; } function"), ("a.cs", "class A { void M( { int x = 1; }"), ("a.php", "<?php class A { function f( { $x = 1;"), ("a.lua", "function f( if x then")])
def test_damaged_sources_have_no_targets(path, text):
    x = extract(path, text.encode())
    assert x["status"] == "recovered_incomplete" and all(o["target"] is None for o in x["occurrences"])
    for i in range(len(text)):
        extract(path, text[:i].encode())


def test_facts_as_rows(spark):
    rows = [("r1", "a.rs", b"pub fn f(x: u8) { g(x) }"), ("r2", "b.rs", b""), ("r3", "c.rs", b"\xff"), ("r4", None, b"x"), ("r5", "d.rs", None)]
    df = spark.createDataFrame([(r, p, None if b is None else bytearray(b)) for r, p, b in rows], "revision string, path string, bytes binary")
    got = extract_all(df).collect()
    assert {(r.revision, r.status) for r in got if r.fact == "file"} == {("r1", "recovered"), ("r2", "recovered"), ("r3", "invalid_encoding")}
    assert {(r.nth, r.name) for r in got if r.fact == "definition"} == {(0, "f"), (1, "x")}
    assert [(r.name, r.target) for r in got if r.fact == "occurrence" and r.kind == "read"] == [("u8", None), ("x", 1)]


class _Batches:
    """Stands for a table of bodies; gives the function that would run in its workers."""

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_facts_of_many_bodies_are_not_held_at_once():
    n = 100
    body = b"".join(b"pub fn f%d(x: u8) { g(x) }\n" % i for i in range(100))
    batch = pa.record_batch([[f"r{i}" for i in range(n)], ["a.rs"] * n, [body] * n], names=["revision", "path", "bytes"])
    each = 1 + sum(len(extract("a.rs", body)[k]) for k in ("definitions", "occurrences", "relationships", "modules"))
    sizes, files = [], []
    for out in extract_all(_Batches())(iter([batch, batch.slice(0, 0)])):
        sizes.append(out.num_rows)
        files += [r for r, f in zip(out["revision"].to_pylist(), out["fact"].to_pylist()) if f == "file"]
    assert sum(sizes) == n * each and max(sizes) <= 5000 and files == [f"r{i}" for i in range(n)]


def test_facts_of_one_body_come_in_parts():
    body = b"".join(b"pub fn f%d(x: u8) { g(x) }\n" % i for i in range(2000))
    parts = list(extract_all(_Batches())(iter([pa.record_batch([["r"], ["a.rs"], [body]], names=["revision", "path", "bytes"])])))
    x = extract("a.rs", body)
    names = [n for p in parts for n, f in zip(p["name"].to_pylist(), p["fact"].to_pylist()) if f in ("definition", "occurrence")]
    assert names == [y["name"] for k in ("definitions", "occurrences") for y in x[k]] and len(names) > 5000 > max(p.num_rows for p in parts)


def test_only_the_facts_asked_for_become_rows():
    batch = pa.record_batch([["r"], ["a.ts"], [b'import { q } from "./q"; q(1);']], names=["revision", "path", "bytes"])
    whole = [r for b in extract_all(_Batches())(iter([batch])) for r in b.to_pylist()]
    got = [r for b in extract_all(_Batches(), ("module",))(iter([batch])) for r in b.to_pylist()]
    assert got == [r for r in whole if r["fact"] == "module"] and [r["name"] for r in got] == ["./q"] and len(whole) > 2


def test_only_the_columns_asked_for_leave_the_worker(spark, small):
    batch = pa.record_batch([["r", "s"], ["a.ts", "b.txt"], [b'import { q } from "./q"; q(1);', b"x"]], names=["revision", "path", "bytes"])
    whole = [r for b in extract_all(_Batches())(iter([batch])) for r in b.to_pylist()]
    parts = list(extract_all(_Batches(), columns=("status", "fact", "kind"))(iter([batch])))
    assert [r for b in parts for r in b.to_pylist()] == [{k: r[k] for k in ("status", "fact", "kind")} for r in whole] and len(whole) > 4
    x = changes.extract_syntax(spark, small)
    assert re.findall(r"MapInArrow run\(.*, \[(.*)\]", re.sub(r"#\d+L?", "", x._jdf.queryExecution().optimizedPlan().toString())) == ["status, fact, kind"]
    want = stores._facts(spark, small).groupBy("fact", "kind", "status").count().collect()
    assert {tuple(r) for r in x.collect()} == {tuple(r) for r in want} and len(want) > 10


def test_php_markers_are_looked_for_in_php_bodies(spark, small, monkeypatch):
    seen, real = [], extract_all
    with monkeypatch.context() as m:
        m.setattr(extraction, "extract_all", lambda bodies, *a: seen.append(bodies.select("path").distinct().collect()) or real(bodies, *a))
        got = {tuple(r) for r in stores.php_markers(spark, small).collect()}
    assert {r.path.rsplit(".", 1)[-1].lower() for r in seen[0]} <= {"php", "phtml"} and len(seen) == 1
    x = stores._facts(spark, small).where("fact = 'definition' AND (canonical IS NOT NULL OR visibility IS NOT NULL) AND kind <> 'import'")
    assert got == {tuple(r) for r in x.groupBy("kind", "visibility", "abstract", "conditional", "complete").count().collect()} and got


def test_php_markers_of_bodies_that_stand_under_other_paths_too(spark, tmp_path):
    body = bytearray(b"<?php class A { public function f() {} private function g() {} }")
    paths = [("r", "a/x.inc"), ("r", "b/x.php"), ("r", "c/x.PHTML"), ("s", "a/y.php"), ("t", "a/z.inc"), ("u", None)]
    spark.createDataFrame([(i, "m", p, r, None, None, None, 1, None) for i, (r, p) in enumerate(paths)], "id long, member string, path string, revision string, language string, status string, bytes long, generation long, observed_at timestamp").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(r, body) for r in "rstu"], "revision string, bytes binary").write.parquet(f"{tmp_path}/contents.parquet")
    got = {(r.kind, r.visibility): r.n for r in stores.php_markers(spark, str(tmp_path)).collect()}
    assert got == {("class", None): 2, ("method", "public"): 2, ("method", "private"): 2}
