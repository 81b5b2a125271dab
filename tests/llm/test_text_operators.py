"""Leakage, mixing, reading level, neighbours: small fixtures, brute force and held-out accuracy."""

import random
import signal

import numpy as np
import pytest

pytest.importorskip("srcatlas.llm")
from srcatlas.llm import leakage, mixing, neighbours, readability  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, member string, grade int"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


WORDS = [a + b for a in "ba de fi go lu mo ne pi ra su ta vo".split() for b in "bel dor fin gam kel mor nat pol rin sar tun vas".split()]


def item(seed, n=60):
    rng = random.Random(seed)
    return " ".join(sentence(rng, 10, WORDS) for _ in range(n // 10))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_myers_matches_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert leakage.myers(a, b) == levenshtein(a, b)


def test_normalised_words():
    assert leakage.words("<em>Nos</em> **G\\u00e9n\\u00e9r**al-\n  ités\\nX") == leakage.words("nos généralités x")
    assert leakage.words("Тhе bаd trее") == ["the", "bad", "tree"]
    assert leakage.words("a​b­c &eacute;té") == ["abc", "ete"]


def test_leaks(spark):
    a, b, c = item(1), item(2), item(3)
    other = lambda k: item(100 + k, 80)
    wa = a.split()
    changed = " ".join(w if i % 8 else "zzz" for i, w in enumerate(wa))
    shuffled = wa[:]
    random.Random(1).shuffle(shuffled)
    two = " ".join(wa[:15]) + " " + other(1) + " " + " ".join(wa[40:55])
    docs = [
        (1, other(2) + a + other(3)), (2, changed + other(4)), (3, " ".join(shuffled)), (4, " ".join(wa[:9]) + other(5)), (5, two), (6, " ".join(wa[:26]) + "."), (7, None), (8, ""), (9, a.upper().replace(" ", "  \n> ")),
        (10, other(6) * 3000 + b), (11, a), (11, a), (None, a),
    ]
    d = spark.createDataFrame([(i, t, None, None, None, None) for i, t in docs], DOCS)
    items = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a), (5, ""), (6, None), (None, a), (7, "two words")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked(d, items).collect())
    want = sorted([(i, k) for i in (1, 2, 5, 6, 9, 11, 11) for k in (1, 4)] + [(10, 2)])
    assert got == want
    assert leakage.leaked(d, items.limit(0)).count() == 0 and leakage.leaked(d.limit(0), items).count() == 0


def test_standing_instruction_is_no_leak(spark):
    note = "Answer with the path and the line range of every place you used and nothing else."
    items = [(k, item(200 + k, 20) + " " + note) for k in range(4)]
    d = spark.createDataFrame([(1, item(300, 60) + " " + note, None, None, None, None), (2, items[2][1], None, None, None, None)], DOCS)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 2)}


def test_second_run_behind_many_copies_of_the_first():
    w = item(1).split()
    other = lambda k: item(500 + k, 60)
    doc = " ".join(f"{' '.join(w[:15])} {other(k)}" for k in range(60)) + " " + " ".join(w[40:52])
    (got,) = leakage.Index([(7, item(1))]).search([doc])
    assert got[:2] == (0, 0) and got[2] >= 26
    assert not leakage.Index([(7, item(1))]).search([" ".join(w[40:52]) + " " + doc.rsplit(" ", 12)[0]])


def test_best_pair_of_runs_matches_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        n, runs = rng.randrange(20, 60), []
        for _ in range(rng.randrange(1, 60)):
            i, x, k = rng.randrange(n), rng.randrange(300), rng.randrange(6, 12)
            runs.append((rng.randrange(3, k + 1), i, i + k, x, x + k, rng.randrange(k)))
        need, want = n * leakage.SHARE, 0
        for q in runs:
            for r in [None, *runs]:
                if r is None or q[2] <= r[1] + 2 and q[4] <= r[3] + 2:
                    if (q[5] + (r[5] if r else 0)) * 4 >= need:
                        want = max(want, q[0] + (r[0] if r else 0))
        assert leakage.Index.best(n, runs) == (want if want >= need - 1e-9 else 0)


def test_exponent_bisection():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0, "d": 0.0}
    w1 = mixing.temperature_weights(sizes, 1.0)
    assert abs(w1["a"] - 0.9) < 1e-12 and w1["d"] == 0
    x = mixing.bisect_exponent(sizes, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.temperature_weights(sizes, x)) - 0.8) < 1e-9
    y = mixing.bisect_exponent(sizes, budget=1000, max_repeats={"a": 1, "b": 2, "c": 4})
    w = mixing.temperature_weights(sizes, y)
    assert w["c"] * 1000 <= 40 + 1e-6 and 0 < y < 1


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))), None, s, None, None) for i, s in enumerate([" Big "] * 300 + ["small"] * 30 + ["SMALL"] * 10 + ["tiny"] * 3 + ["else"] * 20)]
    rows += [(900, None, None, "big", None, None), (901, "", None, "big", None, None), (None, "x y", None, "big", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 9), ("tiny", 0.15, 2), ("none", 0.05, 3)], "source string, target_share double, max_repeats long")
    used, report = mixing.mix(d, t, block_documents=16)
    rep = {r.source: r for r in report.collect()}
    total = sum(r.tokens for r in mixing.with_tokens(d).collect())
    assert rep["none"].reached_tokens == 0 and not rep["none"].reachable and not rep["tiny"].reachable
    assert rep["tiny"].reached_tokens == 2 * rep["tiny"].tokens and rep["tiny"].most_copies == 2
    longest = max(r.tokens for r in mixing.with_tokens(d).collect())
    for s in ("big", "small"):
        assert rep[s].reachable and 0 <= rep[s].target_share * total - rep[s].reached_tokens < longest
    copies = used.collect()
    assert len({r.doc_id for r in copies}) == len(copies) and max(r.copies for r in copies if r.source == "small") - min(r.copies for r in copies if r.source == "small") <= 1
    assert mixing.reachable(mixing.source_sizes(mixing.with_tokens(d), t)).where("NOT reachable").count() == 2
    again = {(r.doc_id, r.copies) for r in mixing.mix(d.repartition(7), t, block_documents=16)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in copies}
    e_used, e_report = mixing.mix(d.limit(0), t)
    assert e_used.count() == 0 and e_report.count() == 4


def test_exponent_above_one_reaches_a_concentrated_target():
    sizes = {"a": 500.0, "b": 300.0, "c": 200.0}
    x = mixing.bisect_exponent(sizes, target_entropy=0.3)
    assert x > 1 and abs(mixing.entropy(mixing.temperature_weights(sizes, x)) - 0.3) < 1e-9


def test_plan_limits_tempered_weights_by_repeats():
    rows = [{"source": k, "target_share": None, "max_repeats": m, "documents": 9, "tokens": n, "all_tokens": 1000} for k, n, m in (("a", 900, 1), ("b", 90, 2), ("c", 10, 4))]
    got = {r["source"]: r for r in mixing.plan(rows)}
    assert all(r["reachable"] and r["budget"] <= r["possible_tokens"] for r in got.values()) and got["c"]["budget"] > 10
    assert abs(sum(r["budget"] for r in got.values()) - 1000) < 1e-2
    rows[0]["target_share"] = 0.95
    got = {r["source"]: r for r in mixing.plan(rows)}
    assert not got["a"]["reachable"] and abs(got["b"]["wanted_tokens"] + got["c"]["wanted_tokens"] - 50) < 1e-6


def test_mix_without_targets(spark):
    rows = [(i, " ".join(WORDS[:20]), None, s, None, None) for i, s in enumerate(["big"] * 40 + ["small"] * 4)]
    d = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "source string, target_share double, max_repeats long")
    used, report = mixing.mix(d, none)
    assert {r.doc_id: r.copies for r in used.collect()} == {i: 1 for i in range(44)}
    total = sum(r.tokens for r in report.collect())
    half = {r.source: r for r in mixing.mix(d, none, total_tokens=total // 4)[1].collect()}
    assert half["small"].reached_share > 0.25 and half["small"].most_copies == 1


def graded(n, seed):
    rng = random.Random(seed)
    easy, mid, hard = WORDS[:40], WORDS[40:80], WORDS[80:]
    out = []
    for i in range(n):
        g = 1 + i % 5
        words = easy * 3 + (mid * 2 if g >= 2 else []) + (hard * (g - 2) * 2 if g >= 3 else [])
        out.append((i, " ".join(sentence(rng, 4 + 4 * g, words) for _ in range(12)), g))
    return out


def test_reading_grades_on_held_out_documents(spark):
    data = graded(500, 4)
    rows = [(i, t, None, "s", None, None) for i, t, _ in data] + [(9001, None, None, "s", None, None), (9002, "", None, "s", None, None), (9003, "`code` src/x.rs:3", None, "s", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, g, "x") for i, _, g in data[:300]] + [(1, 2, "x"), (2, 3, "y"), (None, 3, "z"), (5, 77, "q")], "doc_id long, grade int, member string")
    got = {r.doc_id: r.grade for r in readability.grades(d, labels).collect()}
    held = [(got[i], g) for i, _, g in data[300:]]
    assert np.mean([a == b for a, b in held]) > 0.8 and np.mean([(a >= 4) == (b >= 4) for a, b in held]) > 0.95
    assert got[9001] == 1 and got[9002] == 1 and 1 <= got[9003] <= 5
    none = readability.grades(d.limit(3), labels.limit(0)).collect()
    assert [r.grade for r in none] == [3, 3, 3]


def test_acquisition_grades_follow_use():
    counts = np.array([[10, 10, 10, 10, 10], [0, 0, 0, 10, 10], [0, 0, 1, 0, 20.0]])
    a = readability.acquisition(counts, np.array([1000.0] * 5))
    assert a[0] < a[1] < a[2]


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 64))
    rows = [(f"k{i:04d}", (v * rng.uniform(0.1, 30)).tolist(), 1) for i, v in enumerate(base)]
    for i in range(60):
        near = base[i] + rng.normal(size=64) * np.linalg.norm(base[i]) * rng.uniform(0.01, 0.08)
        rows.append((f"n{i:04d}", near.tolist(), 1))
    for i in range(5):
        rows.append((f"c{i}", (base[7] * 2.0).tolist(), 1))
    return rows


def test_pairs_match_brute_force(spark):
    rows = vectors()
    bad = [("z1", None, 1), ("z2", [0.0] * 64, 1), ("z3", [1.0] * 63, 1), ("z4", [float("nan")] * 64, 1), ("z5", [float("inf")] + [1.0] * 63, 1), (None, [1.0] * 64, 1), ("k0000", [0.0] * 64, 0), ("z6", [1.0, None] + [1.0] * 62, 1)]
    v = spark.createDataFrame(rows + rows[:10] + bad, "key string, vector array<float>, touched long")
    got = {(r.key_a, r.key_b) for r in neighbours.similar_pairs(v, list_size=32, block=16).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, k = x @ x.T, [r[0] for r in rows]
    want = {(min(k[i], k[j]), max(k[i], k[j])) for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}
    assert got == want
    top = neighbours.top_k(v, spark.createDataFrame([("k0007",), ("k0100",), ("nope",)], "key string"), k=5, list_size=64, probe_power=1.0).collect()
    by = {}
    for r in sorted(top, key=lambda r: (r.key, r.rank)):
        by.setdefault(r.key, []).append(r.neighbour)
    assert set(by["k0007"]) == {f"c{i}" for i in range(5)} and len(by["k0100"]) == 5 and "nope" not in by
    i = k.index("k0100")
    best = [k[j] for j in np.argsort(-s[i]) if j != i][:5]
    assert len(set(best) & set(by["k0100"])) >= 4
    assert neighbours.similar_pairs(v.limit(0)).count() == 0 and neighbours.top_k(v.limit(0)).count() == 0


def test_large_class_of_copies_is_a_star(spark):
    rows = vectors()[:50] + [(f"q{i:03d}", [1.0] * 64, 1) for i in range(40)] + [("p", [1.0] * 63 + [1.1], 1)]
    v = spark.createDataFrame(rows, "key string, vector array<float>, touched long")
    got = {(r.key_a, r.key_b) for r in neighbours.similar_pairs(v, list_size=32).collect() if r.key_a[0] in "pq"}
    assert got == {("q000", f"q{i:03d}") for i in range(1, 40)} | {("p", "q000")}


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.Centroids.fit(x, 1500)
    ids, _ = c.nearest(x[:200], 4)
    true = np.argsort(-(x[:200] @ c.leaves.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids, true)]) > 0.6
    assert np.mean(ids[:, 0] == true[:, 0]) > 0.7


@pytest.mark.parametrize("lists,n", [(40, 10), (1500, 370), (2001, 500)])
def test_graph_search_reaches_as_many_lists_as_asked_at_every_size(lists, n, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4 * lists, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.Centroids.fit(x, lists)
    calls = []
    monkeypatch.setattr(c, "graph", type("G", (), {"shape": c.graph.shape, "__getitem__": lambda _, i, g=c.graph: calls.append(1) or g[i]})())
    ids, sim = c.nearest(x[:20], n)
    assert calls and all(len(set(r)) == n for r in ids.tolist()) and sim.min() > -1.01
    true = np.argsort(-(x[:20] @ c.leaves.T), axis=1)[:, :n]
    assert np.mean([len(set(a) & set(b)) / n for a, b in zip(ids, true)]) > 0.95


@pytest.mark.parametrize("n", [6, 90])
def test_graph_search_ends_where_lists_are_equally_similar(n):
    """Centroids as similar to a row as the last of its beam: none of them may be taken up again and again."""
    rng = np.random.default_rng(4)
    few = rng.normal(size=(3, 64)).astype(np.float32)
    few /= np.linalg.norm(few, axis=1, keepdims=True)
    c = neighbours.Centroids.of(np.repeat(few, [150, 150, 20], axis=0), few)
    # near centroids of equal ones, in both directions
    c.graph = rng.integers(0, len(c.leaves), c.graph.shape).astype(np.int32)

    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        ids, sim = c.nearest(few[[0, 1, 2, 0]], n)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert all(len(set(r)) == n for r in ids.tolist()) and (np.diff(sim, axis=1) <= 0).all() and sim[0].min() > 0.999


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("lists", [1299, 1300, 4096, 8192])
def test_recall_of_probed_lists_with_the_graph(lists, clustered):
    """Ten nearest by the lists ``top_k`` stores in and probes, against brute force; no step between numbers of lists."""
    rng = np.random.default_rng(5)
    n = lists * 32
    x = rng.normal(size=(n, 64)).astype(np.float32)
    if clustered:
        x = x[rng.integers(0, n // 40, n)] + 0.6 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.Centroids.fit(x, lists)
    q = x[:60]
    true = np.argsort(-(q @ x.T), axis=1)[:, 1:11]
    stored, s = c.nearest(x[true.ravel()], 2)
    d = 2 - 2 * s
    stored = np.where(d <= 1.3 * np.maximum(d[:, :1], 1e-6), stored, -1).reshape(len(q), 10, 2)
    probed, s = c.nearest(q, max(8, int(np.ceil(len(c.leaves) ** 0.8))))
    d = 2 - 2 * s
    probed = np.where(d <= 4 * np.maximum(d[:, :1], 1e-6), probed, -2)
    assert np.mean([np.isin(a, b).any(1).mean() for a, b in zip(stored, probed)]) >= 0.9


def test_top_k_in_blocks_equals_brute_force(spark):
    """Lists and probes in many blocks, every vector a query, all lists probed."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    v = spark.createDataFrame([(f"v{i:03d}", r.tolist(), 1) for i, r in enumerate(x)], "key string, vector array<float>, touched long")
    got = {}
    for r in neighbours.top_k(v, k=10, list_size=50, probe_power=1.0, probe_ratio=100.0, first=2, block=16).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for i in range(300):
        assert got[f"v{i:03d}"] == {f"v{j:03d}" for j in np.argsort(-s[i]) if j != i and j in set(np.argsort(-s[i])[:11])}


def test_part_of_a_long_item_is_found_wherever_its_document_stands():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000))
    index = leakage.Index([(1, text)])
    tail = " ".join(text.split()[1600:3000])
    alone, behind = index.search([tail]), index.search(["nothing here", tail])
    assert [x[2:] for x in alone] == [(1400, 1400 / 3000)] and [x[2:] for x in behind] == [(1400, 1400 / 3000)]


def test_passes_over_the_items_change_nothing(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    shared = "Answer the following question with one short sentence and give no reasons for it at all please."
    rows = [(i, f"{shared} {' '.join(word() for _ in range(24))}.") for i in range(6)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"intro {shared} outro"), (2, "x " + rows[4][1] + " y"), (3, None)], "doc_id long, text string")
    found = lambda **o: sorted((r.doc_id, r.item_id, r.matched_words) for r in leakage.leaked(docs, items, **o).collect())
    assert found() == found(max_item_bytes=200) == [(2, 4, 41)]


@pytest.mark.parametrize(
    "text", ["東京の天気は明日から雨になるでしょう。傘を忘れずに持って行ってください。夜は風も強くなります", "in 1914 the 12 ships of 3 fleets met 27 others near 58 degrees north and 4 sank", "Съешь же ещё этих мягких французских булок, да выпей чаю"]
)
def test_items_of_other_scripts_numbers_and_few_words(text):
    assert [(d, i) for d, i, _, _ in leakage.Index([(5, text)]).search(["something else entirely", f"before {text} after"])] == [(1, 0)]
    assert leakage.Index([(5, "")]).search(["a b", ""]) == []
    assert [i for _, i, _, _ in leakage.Index([(5, "two words")]).search(["here are two words again"])] == [0]


def test_pigeonhole_pieces_survive_every_choice_of_errors():
    rng = np.random.default_rng(4)
    for n in (45, 50, 73, 100, 149):
        s, e, p = leakage.pieces(n)
        assert (s - p + 1) // p >= e + 1
        seq = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]
        for _ in range(20):
            doc = list(seq)
            for i in sorted(rng.choice(n, n // 8, replace=False), reverse=True):
                if rng.random() < 0.5:
                    doc[i] = "other"
                else:
                    del doc[i]
            assert [x[:2] for x in leakage.Index([(1, " ".join(seq))]).search(["lead in " + " ".join(doc) + " tail"])] == [(0, 0)]


def test_sources_are_the_same_whatever_surrounds_them_and_entropy_decides_the_mix(spark):
    docs = spark.createDataFrame([(i, "word " * 50, s, None, None, None) for i, s in enumerate(["A\t"] * 30 + [" a"] * 30 + ["b"] * 40 + ["c"] * 20)], "doc_id long, text string, source string, lang string, member string, grade int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("A ", 0.1, 9), ("b", 0.5, 2)], "source string, target_share double, max_repeats long")
    used, report = mixing.mix(docs, targets)
    got = {r.source.strip().lower(): r for r in report.collect()}
    assert got["a"].target_share == 0.5 and got["a"].documents == 60 and used.where("lower(trim(source)) = 'a'").count() == 60
    free = targets.where("max_repeats = 2").selectExpr("source", "CAST(NULL AS DOUBLE) AS target_share", "max_repeats")
    flat, steep = ({r.source: r.budget for r in mixing.mix(docs, free, total_tokens=4000, target_entropy=h)[1].collect()} for h in (0.6931, 0.3))
    assert abs(flat["a"] - flat["b"]) < 50 and steep["a"] > 1.5 * steep["b"]


def test_held_out_figures(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, 4 + 4 * g, WORDS[24 * (g - 1) : 24 * g + 12]) for _ in range(12)), g) for i, g in enumerate([1, 2, 3, 4, 5] * 30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "no mark")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 2), (3, 9)], "doc_id long, grade int")
    got = readability.held_out(docs, marks).collect()
    assert sum(r.documents for r in got) == 150 and sum(r.documents for r in got if abs(r.mark - r.grade) <= 1) > 130
    assert readability.held_out(docs, marks.limit(0)).count() == 0
