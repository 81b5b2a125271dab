"""The search pipeline on small corpora: lanes, filters, evidence, priors, snippets, patterns, the index against plain scans."""

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import filters, fusion, lanes
from srcatlas.operators import search as S
from srcatlas.operators.postings import Postings

REG = "id long, path string, name string, expanded string, body string, kind string, language string, span_start long, span_end long"
DEF = "id long, path string, name string, kind string, container string, language string, span_start long, span_end long"
OCC = "path string, name string, span_start long, span_end long, role string, language string"


def corpus(spark):
    regions = [
        (1, "src/tick_rate.rs", "tick_rate", "tick rate", "fn tick_rate() -> u32 {\n    // slow item\n    let item = slot;\n}\n", "function", "rust", 0, 60),
        (2, "src/clock.rs", "advance", "advance", "fn advance() { tick_rate(); tick_rate(); }", "function", "rust", 0, 40),
        (3, "src/tests/clock.rs", "checks", "checks", "fn checks() { tick_rate(); rate tick }", "function", "rust", 0, 40),
        (4, "docs/guide.md", "", "", "The tick rate of the clock, über alles", "region", "text", 0, 40),
        (5, "web/item.ts", "Item", "item", "class Item { slot: number }\nunknown item slot", "class", "typescript", 0, 45),
        (6, "web/empty.ts", None, None, None, None, None, None, None),
    ]
    defs = [(1, "src/tick_rate.rs", "tick_rate", "function", None, "rust", 0, 60), (2, "src/clock.rs", "advance", "function", "Clock", "rust", 0, 40), (3, "web/item.ts", "tick_rate", "import", None, "typescript", 5, 10)]
    occ = [("src/tick_rate.rs", "tick_rate", 3, 12, "declaration", "rust"), ("src/clock.rs", "tick_rate", 15, 24, "call", "rust"), ("src/clock.rs", "tick_rate", 28, 37, "call", "rust"), ("src/clock.rs", "Clock", 1, 2, "type", "rust"), ("src/tests/clock.rs", "tick_rate", 14, 23, "call", "rust")]
    r = spark.createDataFrame(regions, REG)
    return S.Corpus(r, None, spark.createDataFrame(defs, DEF), spark.createDataFrame(occ, OCC), None, Postings.build(r))


@pytest.fixture(scope="module")
def small_corpus(spark):
    return corpus(spark)


def paths(df):
    return [r.path for r in df.orderBy("rank").collect()]


def test_identifier_ranks_named_defined_used_absent(small_corpus):
    got = S.search(small_corpus, "tick_rate").orderBy("rank").collect()
    assert [r.tier for r in got] == sorted(r.tier for r in got)
    tiers = {r.path: r.tier for r in got}
    # the import of the name is a use; a document that only holds the words comes last
    assert tiers["src/tick_rate.rs"] == 0 and tiers["src/clock.rs"] == tiers["web/item.ts"] == 2 and tiers["docs/guide.md"] == 3
    assert got[0].provenance == "exact_identifier" and got[0].name == "tick_rate"
    assert [r.provenance for r in got if r.path == "src/clock.rs"] == ["identifier_occurrence"]


def test_qualifier_needs_both_names(small_corpus):
    got = {r.path: r.tier for r in S.search(small_corpus, "Clock::tick_rate").collect()}
    assert got["src/clock.rs"] == 2 and got.get("src/tests/clock.rs", 3) == 3


def test_literal_is_only_a_phrase_and_skips_the_vector_lane(spark, small_corpus):
    got = S.search(small_corpus, '"unknown item slot"')
    assert paths(got) == ["web/item.ts"] and {r.provenance for r in got.collect()} == {"phrase"}
    v = spark.createDataFrame([(4, "docs/guide.md", [1.0, 0.0]), (5, "web/item.ts", [0.0, 1.0])], "id long, path string, vector array<double>")
    with_vectors = S.Corpus(small_corpus.regions, None, small_corpus.definitions, small_corpus.occurrences, v, small_corpus.postings)
    assert paths(S.search(with_vectors, '"unknown item slot"', vector=[1.0, 0.0])) == ["web/item.ts"]
    assert "docs/guide.md" in paths(S.search(with_vectors, "unknown item", vector=[1.0, 0.0]))


def test_filters_hold_in_every_lane(small_corpus):
    assert set(paths(S.search(small_corpus, "tick_rate lang:rust"))) == {"src/tick_rate.rs", "src/clock.rs", "src/tests/clock.rs"}
    assert set(paths(S.search(small_corpus, "tick_rate file:src -file:tests"))) == {"src/tick_rate.rs", "src/clock.rs"}
    assert paths(S.search(small_corpus, "item kind:class")) == ["web/item.ts"]
    assert paths(S.search(small_corpus, "item lang:php")) == []
    assert paths(S.search(small_corpus, "sym:tick_rate lang:rs")) == ["src/tick_rate.rs"]
    assert paths(S.search(small_corpus, "sym:tick_rate")) == ["src/tick_rate.rs", "web/item.ts"]
    assert paths(S.search(small_corpus, "file:web/")) == ["web/empty.ts", "web/item.ts"]


def test_pattern_matches_over_line_ends(small_corpus):
    got = S.search(small_corpus, r"re:\{\n    //").collect()
    assert [(r.path, r.span_start, r.span_end) for r in got] == [("src/tick_rate.rs", 22, 30)]
    assert paths(S.search(small_corpus, "re:^unknown")) == ["web/item.ts"]
    assert paths(S.search(small_corpus, "re:slot kind:class")) == []
    assert paths(S.search(small_corpus, "re:tick_rate kind:function lang:rust")) == ["src/clock.rs", "src/tick_rate.rs"]


def test_one_match_a_line_with_byte_offsets(spark):
    t = spark.createDataFrame([(1, "é a a\nb a"), (2, None), (3, "a\0")], "id long, body string")
    assert sorted((r.id, r.line, r.start, r.end) for r in lanes.regex_matches(t, "a").collect()) == [(1, 1, 3, 4), (1, 2, 9, 10)]


def test_prior_lifts_only_the_class_a_filter_names(spark):
    d = spark.createDataFrame([("src/tests/a.rs",), ("docs/a.md",), ("src/a.rs",)], "path string")
    weigh = lambda text: [r[0] for r in d.select(_prior(text)).collect()]

    def _prior(text):
        q = filters.parse_query(text)
        return fusion.path_prior(F.col("path"), lanes.name_terms(q.text), q.includes, False, q.kind, q.language)

    assert weigh("tick rate") == [0.7, 0.7, 1.0]
    assert weigh("tick file:src/tests/") == [1.0, 0.7, 1.0]
    assert weigh("tick file:docs/") == [0.7, 1.0, 1.0]
    assert weigh("tick file:src/latest/") == [0.7, 0.7, 1.0]
    assert weigh("tick lang:text") == [0.7, 1.0, 1.0]
    assert weigh("tick kind:file") == [1.0, 1.0, 1.0]
    assert weigh("the docs") == [0.7, 1.0, 1.0]


def test_snippets_weigh_terms_code_and_names(spark):
    d = spark.createDataFrame(
        [(1, "x", "let y = 1;\n// item of a slot"), (2, "x", "// unknown item slot faults\nlet x = item;"), (3, "x", "// unknown item slot\nlet slot = item.slot();"), (4, "refill", "/// Refills.\n#[inline]\npub fn refill(&mut self) {"), (5, "", "   \n\t"), (6, None, None)],
        "id long, name string, body string",
    )
    got = {r.id: (r.line, r.snippet) for r in fusion.snippets(d, ["unknown", "item", "slot"]).collect()}
    # a comment with a term goes before code without one
    assert got == {1: (2, "// item of a slot"), 2: (1, "// unknown item slot faults"), 3: (2, "let slot = item.slot();"), 4: (3, "pub fn refill(&mut self) {")}


def test_index_equals_scans(spark, small_corpus):
    r = small_corpus.regions
    for terms in (["tick"], ["rate", "tick"], ["item", "slot", "nothing"], ["uber"]):
        for need_all in (False, True):
            a, b = (lanes.any_terms(x, terms, need_all).select("id", "path", "score", "rank") for x in (r, small_corpus.postings))
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        a, b = (lanes.phrase(x, terms).select("id", "path", "score", "rank") for x in (r, small_corpus.postings))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert [r.path for r in lanes.any_terms(small_corpus.postings, ["uber"]).collect()] == ["docs/guide.md"]
    plan = small_corpus.postings.features([["tick"], ["rate"]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
    assert plan.count("Scan parquet") == 1 or plan.count("FileScan parquet") == 1


def test_rerank_and_snippets_in_the_pipeline(small_corpus):
    got = S.search(small_corpus, "item slot", scorer=-F.length("body").cast("double"), snippets=True).orderBy("rank").collect()
    assert got[0].path == "web/item.ts" and got[0].snippet and [r.rank for r in got] == list(range(1, len(got) + 1))


def test_empty_corpus(spark):
    c = corpus(spark)
    none = S.Corpus(c.regions.limit(0), None, c.definitions.limit(0), c.occurrences.limit(0))
    for text in ("a b", "tick_rate", '"a b"', "sym:x", "re:x", "::", "file:none x"):
        assert S.search(none, text).count() == 0
