"""Golden graphs, brute force and properties for patterns and counts."""

import random

import pytest

from dependra.operators import collexemes, counting, graphs, structures
from dependra.plans import compiler
from dependra.plans.pattern import Association, Pattern, canonical_order, from_adjacency, parse, skeletize, split_association, to_adjacency
from tests import helpers as H

V = lambda wc, lemma=None, **k: {"wc": wc, "lemma": lemma or wc.lower(), "word": lemma or wc, "pos": wc[0], **k}

G1 = (
    [V("DET", "the"), V("NOUN", "bear"), V("VERB", "give"), V("NOUN", "chase"), V("CCONJ", "and"), V("PRON", "I"), V("VERB", "give"), V("NOUN", "chase"), V("PRON", "he"), V("VERB", "say", root="root")],
    [(1, 0, "det"), (2, 1, "nsubj"), (2, 3, "obj"), (2, 6, "conj"), (6, 4, "cc"), (6, 5, "nsubj"), (6, 7, "obj"), (9, 8, "nsubj"), (9, 2, "ccomp")],
)


def found(corpus, pattern):
    return {(r[0], tuple(r[1:])) for r in compiler.embeddings(corpus, pattern).collect()}


def table(df):
    return {r["method"]: (r["o11"], r["r1"], r["c1"], r["n"], r["inconsistent"]) for r in df.collect()}


def test_three_verbs(spark):
    verb, say = {"wc": "VERB"}, {"wc": "VERB", "lemma": "say"}
    n = Pattern((verb,), (), vids=(1,))
    a = Pattern(({"wc": "VERB", "lemma": "give"},), (), vids=(1,))
    b = Pattern((say, verb), ((0, 1, {"relation": "ccomp"}),), vids=(0, 1))
    c = Pattern((say, {"wc": "VERB", "lemma": "give"}), ((0, 1, {"relation": "ccomp"}),), vids=(0, 1))
    got = table(counting.association(H.corpus(spark, G1), Association(c, a, b, n, 0)))
    assert got == {m: (1, 2.0, 1.0, 3, 0) for m in ("embeddings", "subgraphs", "focus_points")} | {"sentences": (1, 1.0, 1.0, 1, 0)}


def test_inconsistent_unit(spark):
    g = ([V("VERB", root="root"), V("NOUN"), V("ADJ")], [(0, 1, "obj"), (0, 2, "amod")])
    q = parse({"nodes": [{"id": 0, "query": "AB", "wc": "VERB"}, {"id": 1, "query": "AB"}, {"id": 2, "query": "A"}, {"id": 3, "query": "B"}],
               "links": [{"source": 0, "target": 1, "relation": "obj"}, {"source": 0, "target": 2}, {"source": 0, "target": 3, "relation": "amod"}]})
    assert table(counting.association(H.corpus(spark, g), split_association(q)))["embeddings"] == (0, 0.5, 0.5, 1, 1)


def test_symmetric_pairs(spark):
    g = ([V("NOUN", root="root"), V("ADJ", "x"), V("ADJ", "y")], [(0, 1, "amod"), (0, 2, "amod")])
    q = Pattern(({"focus_point": True}, {"collo_A": True}, {"collo_B": True}), ((0, 1, {"relation": "amod"}), (0, 2, {"relation": "amod"})))
    rows = collexemes.covarying(H.corpus(spark, g), q).collect()
    assert {(r.item_a, r.item_b) for r in rows} == {("x", "y"), ("y", "x")}
    assert {r.method: r.n for r in rows} == {"embeddings": 2, "subgraphs": 1, "focus_points": 1, "sentences": 1}


def random_sentence(rng):
    n = rng.randint(2, 6)
    vertices = [V(rng.choice(["VERB", "NOUN"]), rng.choice("xyz")) for _ in range(n)]
    vertices[0]["root"] = "root"
    edges = {(rng.randrange(i), i): rng.choice(["obj", "amod", "conj"]) for i in range(1, n)}
    if n > 3:
        a, b = rng.sample(range(n), 2)
        edges.setdefault((a, b), "conj")
    return vertices, [(g, d, r) for (g, d), r in edges.items()]


def test_patterns_by_brute_force(spark):
    rng = random.Random(4)
    sentences = [random_sentence(rng) for _ in range(40)]
    c = H.corpus(spark, *sentences)
    patterns = [
        Pattern(({},), ()),
        Pattern(({"wc": "VERB"}, {"not_wc": "VERB"}), ((0, 1, {}),)),
        Pattern(({"lemma": "x"}, {}, {}), ((0, 1, {"relation": "obj"}), (0, 2, {"not_relation": "obj"}))),
        Pattern(({}, {}, {}), ((0, 1, {}), (1, 2, {}))),
        Pattern(({"not_outdep": ["conj"]}, {"not_indep": ["conj", "amod"]}), ((0, 1, {}),)),
        Pattern(({"root": "root"}, {"not_root": "root"}), ()),
        Pattern(({}, {}, {}), ((0, 1, {}), (1, 2, {}), (0, 2, {}))),
        Pattern(({}, {}), ((0, 1, {}), (1, 0, {}))),
    ]
    for p in patterns:
        assert found(c, p) == {(i, m) for i, s in enumerate(sentences) for m in H.matches(s, p)}, p
        some = {r[0] for r in compiler.candidate_sentences(c, p).collect()}
        assert some >= {i for i, s in enumerate(sentences) if H.matches(s, p)}


QUERIES = [
    {"nodes": [{"id": 0, "query": "AB", "wc": "VERB"}, {"id": 1, "query": "A", "lemma": "x"}, {"id": 2, "query": "B"}], "links": [{"source": 0, "target": 1}, {"source": 0, "target": 2, "relation": "obj"}]},
    {"nodes": [{"id": 0, "query": "AB"}, {"id": 1, "query": "AB", "lemma": "y", "only_A": ["lemma"], "focus_point": True}, {"id": 2, "query": "B", "not_outdep": ["conj"]}], "links": [{"source": 0, "target": 1}, {"source": 1, "target": 2}]},
    {"nodes": [{"id": 3, "query": "AB", "wc": "NOUN", "pos": "N", "only_B": ["wc", "pos"]}, {"id": 5, "query": "A"}], "links": [{"source": 3, "target": 5, "relation": "amod", "only_B": ["relation"]}]},
]


@pytest.mark.parametrize("query", QUERIES)
def test_contingency_by_brute_force(spark, query):
    rng = random.Random(9)
    sentences = [random_sentence(rng) for _ in range(30)]
    q = split_association(parse(query))
    got = table(counting.association(H.corpus(spark, *sentences), q))
    assert got == H.contingency(sentences, q)
    for o11, r1, c1, n, inc in got.values():
        assert o11 + inc / 2 <= min(r1, c1) and r1 + c1 - o11 <= n
    assert got["embeddings"][3] >= got["subgraphs"][3] and got["embeddings"][3] >= got["focus_points"][3] >= got["sentences"][3]


def test_no_match_keeps_all_methods(spark):
    q = split_association(parse({"nodes": [{"id": 0, "query": "AB", "wc": "NONE"}], "links": []}))
    assert table(counting.association(H.corpus(spark, G1), q)) == {m: (0, 0.0, 0.0, 0, 0) for m in counting.METHODS}


def test_legacy_counts(spark):
    rng = random.Random(2)
    sentences = [random_sentence(rng) for _ in range(25)]
    c, q = H.corpus(spark, *sentences), split_association(parse(QUERIES[0]))
    n = sum(len({m[q.focus] for m in H.matches(s, q.n)}) for s in sentences)
    assert table(counting.choke_points(c, q))["focus_points"][3] == n
    assert table(counting.sentence_signatures(c, q))["sentences"][3] == sum(bool(H.matches(s, q.n)) for s in sentences)
    sets = sum(len({frozenset(m) for m in H.matches(s, q.n)}) for s in sentences)
    assert table(counting.edge_set_subgraphs(c, q))["subgraphs"][3] == sets


def test_admission(spark):
    root = lambda *vs: [V("X", root="root"), *vs]
    good = (root(V("X")), [(0, 1, "a")])
    bad = [([V("X"), V("X")], [(0, 1, "a")]), (root(V("X", root="root")), [(0, 1, "a")]), (root(V("X"), V("X")), [(0, 1, "a")]), (root(*[V("X")] * 11), [(0, i, "a") for i in range(1, 12)])]
    dense = (root(*[V("X")] * 9), [(0, i, "a") for i in range(1, 10)] + [(i, j, "b") for i in range(1, 10) for j in range(i + 1, min(10, i + 3))][:10])
    c = H.corpus(spark, good, *bad, dense)
    assert [r[0] for r in graphs.sensible_sentences(c).collect()] == [0]
    assert {r[0]: r[2] for r in graphs.ego_edges(c).where("sentence_id = 5 and position = 0").collect()} == {5: 19}
    assert graphs.reachable(c).where("sentence_id = 3").count() == 2


def test_canonical_order():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 6)
        labels = [rng.choice("ab") for _ in range(n)]
        edges = [(s, t, rng.choice("xy")) for s in range(n) for t in range(n) if s != t and rng.random() < 0.3]
        perm = rng.sample(range(n), n)
        moved = [labels[perm.index(i)] for i in range(n)], [(perm[s], perm[t], e) for s, t, e in edges]

        def text(labels, edges):
            at = {v: i for i, v in enumerate(canonical_order(labels, edges))}
            return sorted((at[v], x) for v, x in enumerate(labels)), sorted((at[s], at[t], e) for s, t, e in edges)

        assert text(labels, edges) == text(*moved)


def test_pattern_tools():
    p = parse({"graph": {"description": "d"}, "nodes": [{"id": 4, "wc": "VERB"}, {"id": 2}], "links": [{"source": 4, "target": 2, "relation": "obj"}]})
    assert p.edges == ((1, 0, {"relation": "obj"}),) and p.name == "d" and p.focus_point() == 1
    assert from_adjacency(to_adjacency(p)).edges == p.edges and p.is_star() and not p.is_purely_structural()
    assert skeletize(p).edges == ((1, 0, {}),) and Pattern(({"word": ".+"},), ()).is_purely_structural()
    with pytest.raises(ValueError):
        Pattern(({"shape": 1},), ())
    with pytest.raises(ValueError):
        Pattern(({"collo_item": False},), ()).marked("collo_item")
    with pytest.raises(ValueError):
        structures.delexicalize(Pattern(({"wc": "VERB"},), ()))


def test_connected_edge_sets():
    edges = [(0, 1), (1, 2), (0, 3), (2, 3)]
    import itertools

    def connected(es):
        todo, rest = set(es[0]), set(es[1:])
        while grown := [e for e in rest if todo & set(e)]:
            for e in grown:
                todo |= set(e)
                rest.discard(e)
        return not rest

    every = {frozenset(es) for k in range(1, 5) for es in itertools.combinations(edges, k) if connected(es)}
    got = [e for _, e in structures.all_connected(edges, 2, 4)]
    assert set(got) == every and len(got) == len(every)
    assert {frozenset(s) for s in structures.node_induced(edges, 2, 2)} == {frozenset(e) for e in edges}


def test_larger_structures(spark):
    rng = random.Random(5)
    sentences = [random_sentence(rng) for _ in range(25)]
    q = Pattern(({"wc": "VERB", "lemma": "x"},), ())
    rows = structures.larger_structures(H.corpus(spark, *sentences), q, max_size=3, min_coocc=1).collect()
    units = {(i, m[0]) for i, s in enumerate(sentences) for m in H.matches(s, Pattern(({"wc": "VERB"},), ()))}
    around = {}
    for i, m in units:
        tokens = [{"position": p, "root": v.get("root") == "root", **{k: v[k] for k in ("word", "pos", "lemma", "wc")}} for p, v in enumerate(sentences[i][0])]
        deps = [{"governor": g, "dependent": d, "relation": r} for g, d, r in sentences[i][1]]
        around[i, m] = structures.surroundings(tokens, deps, [m], q, 3, False)
    lexical = {(i, m) for i, m in units if sentences[i][0][m]["lemma"] == "x"}
    keys = {c: b for u in lexical for c, b in around[u]}
    got = {r.larger_structure: r for r in rows if r.method == "embeddings"}
    assert set(got) == set(keys)
    for c, b in keys.items():
        o11 = sum(any(k == c for k, _ in around[u]) for u in lexical)
        has_b = {u for u in units if any(x == b for _, x in around[u])}
        inc = len(has_b & lexical) - o11
        assert (got[c].o11, got[c].r1, got[c].c1, got[c].n) == (o11, len(lexical) - inc / 2, len(has_b) - inc / 2, len(units))


def test_stars(spark):
    g = ([V("A", root="root"), V("B"), V("B")], [(0, 1, "x"), (0, 2, "x")])
    stars = structures.star_rows(H.corpus(spark, g))
    freq = {(r.length, r.edge_center): (r.star_freq, r.center_freq) for r in structures.star_frequencies(stars).collect()}
    assert sum(x for x, _ in freq.values()) == 2 + 1 + 2
    assert {r.star_freq for r in structures.star_frequencies(stars, skeleton=True).collect()} == {1, 2}
    assert structures.edge_to_skeleton(stars).where("size(skeletons) <> 1").count() == 0


def test_match_operators(spark):
    from dependra.operators import match

    rng = random.Random(11)
    sentences = [random_sentence(rng) for _ in range(30)]
    c = H.corpus(spark, *sentences)
    p = Pattern(({"wc": "VERB"}, {"not_wc": "VERB"}, {}), ((0, 1, {}), (0, 2, {"not_relation": "conj"})))
    every = {(i, m) for i, s in enumerate(sentences) for m in H.matches(s, p)}
    assert {r[0] for r in match.subsumed(c, p).collect()} == {i for i, _ in every}
    assert {tuple(r) for r in match.rooted(c, p, 0).collect()} == {(i, m[0]) for i, m in every}
    places = spark.createDataFrame([(i, v) for i, s in enumerate(sentences) for v in range(len(s[0]))], "sentence_id long, focus int")
    assert match.rooted_at(c, p, 1, places).count() == len({(i, m[1]) for i, m in every})
    counts = {tuple(r)[:2]: r.embeddings for r in match.count_fixed(c, p, 1, places.withColumnRenamed("focus", "position")).collect()}
    assert all(n == sum(j == i and m[1] == v for j, m in every) for (i, v), n in counts.items())
    by_sql = spark.sql(match.pattern_sql(p, "{t}", "{d}"), t=c.tokens, d=c.dependencies)
    assert {(r[0], tuple(r[1:])) for r in by_sql.collect()} == every
    folded = {r.sentence_id: r.m1 for r in match.folded(compiler.embeddings(c, p), p).collect()}
    assert folded == {i: sorted({m[1] for j, m in every if j == i}) for i, _ in every}
    sets = {tuple(r) for r in match.candidate_sets(c, p).collect()}
    assert sets >= {(i, q, x) for i, m in every for q, x in enumerate(m)}
    subs = match.subsets(spark.createDataFrame([(["a", "b", "c"],)], "xs array<string>"), "xs", 1, 2)
    assert sorted(tuple(r.subset) for r in subs.collect()) == [("a",), ("a", "b"), ("a", "c"), ("b",), ("b", "c"), ("c",)]


def test_breadth_first_and_connected(spark):
    from dependra.operators import match

    g = ([V("A", root="root"), V("B"), V("B"), V("B"), V("B")], [(0, 2, "a"), (0, 1, "b"), (2, 4, "z"), (1, 3, "a"), (4, 3, "c")])
    c = H.corpus(spark, g)
    assert [r.position for r in match.breadth_first(c).orderBy("rank").collect()] == [0, 2, 1, 4, 3]
    want = {frozenset(e) for _, e in structures.all_connected([(s, t) for s, t, _ in g[1]], 2, 4)}
    got = structures.connected_subgraphs(c, 2, 4).collect()
    assert {frozenset((e.g, e.d) for e in r.edges) for r in got} == want and len(got) == len(want)


def test_canonical_order_of_symmetric_graphs():
    """Equal leaves, equal branches and cycles: no factorial; the same text from any numbering."""
    import time

    star = [(0, i, "x") for i in range(1, 11)]
    branches = [(0, i, "x") for i in range(1, 7)] + [(i, i + 6, "y") for i in range(1, 7)]
    cycle = [(i, (i + 1) % 12, "x") for i in range(12)]
    crown = [(a, 5 + b, "x") for a in range(5) for b in range(5) if a != b]
    rng = random.Random(7)
    for n, edges, most in ((11, star, 0.01), (13, branches, 0.1), (12, cycle, 0.1), (10, crown, 0.2)):
        texts = set()
        for _ in range(5):
            perm = rng.sample(range(n), n)
            moved = [(perm[s], perm[t], e) for s, t, e in edges]
            took = []
            for _ in range(3):
                began = time.perf_counter()
                order = canonical_order([""] * n, moved)
                took.append(time.perf_counter() - began)
            at = {v: i for i, v in enumerate(order)}
            texts.add(tuple(sorted((at[s], at[t], e) for s, t, e in moved)))
            assert min(took) < most
        assert len(texts) == 1


def test_legacy_refuses_impossible_units(spark):
    from pyspark.errors import PySparkException

    c = H.corpus(spark, G1)
    verb = {"wc": "VERB"}
    n, c_, b = Pattern((verb,), ()), Pattern((verb,), ()), Pattern((verb | {"lemma": "none"},), ())
    with pytest.raises(PySparkException, match="inconsistent classification"):
        counting.isomorphism_counts(c, Association(c_, c_, b, n, 0)).collect()
    q = split_association(parse(QUERIES[0]))
    assert {r["method"] for r in counting.legacy_bundle(c, q).collect()} == set(counting.METHODS)


def test_fragments_and_induced_sets(spark):
    from dependra.operators import match

    loop = ([V("A"), V("B"), V("C"), V("D")], [(1, 2, "x"), (2, 1, "y"), (1, 3, "a"), (3, 0, "b")])
    two = ([V("A"), V("B"), V("C")], [(0, 1, "x"), (2, 1, "a")])
    c = H.corpus(spark, loop, two)
    got = {}
    for r in match.breadth_first(c, fragment=True).orderBy("sentence_id", "rank").collect():
        got.setdefault(r.sentence_id, []).append(r.position)
    assert got == {0: [1, 3, 2, 0], 1: [0, 2, 1]} and match.breadth_first(c).count() == 0
    for i, (vs, es) in enumerate((loop, two)):
        pairs = [(s, t) for s, t, _ in es]
        want = {tuple(sorted(s)): sorted(e for e in pairs if set(e) <= s) for s in structures.node_induced(pairs, 1, 3)}
        rows = structures.connected_vertex_sets(c, 1, 3).where(f"sentence_id = {i}").collect()
        assert {tuple(r.vertices): sorted((e.g, e.d) for e in r.edges) for r in rows} == want and len(rows) == len(want)
    one = structures.star_rows(c, places=spark.createDataFrame([(0, 3)], "sentence_id long, position int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, structures.star_rows(c).where("sentence_id = 0 and center = 3").collect()))


def test_sizes_and_dense_neighbourhoods(spark):
    from dependra.operators import match

    c = H.corpus(spark, G1, ([V("A", root="root")], []))
    assert {tuple(r) for r in c.sizes().collect()} == {(0, 10, 9), (1, 1, 0)}
    assert [r[0] for r in match.large_enough(c, Pattern(({}, {}), ((0, 1, {}),))).collect()] == [0]
    assert [r[0] for r in graphs.sensible_sentences(c).orderBy("sentence_id").collect()] == [0, 1]
