"""Connected subgraphs, stars and associated larger structures.

Enumeration of edge subsets has no relational form of bounded size, so it runs in Arrow batches over one row a sentence; only
sentences that matter get there. All counting is relational: keys are built once for each embedding, then aggregated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dependra.functions.measures import with_measures
from dependra.operators.counting import by_unit
from dependra.plans.compiler import columns, embeddings, extend
from dependra.plans.pattern import Pattern, canonical_order
from dependra.sources.corpus import Corpus

Edge = tuple[int, int]


def connected_edge_sets(edges: list[Edge], start: tuple[frozenset, frozenset], low: int, high: int):
    """All connected sets of edges that contain start (vertices, edges), with low to high vertices: (vertices, edges) each once.

    Grown edge by edge from start; a set is reached on many ways and kept once.
    """
    seen, todo = {start[1]: start[0]}, [start]
    while todo:
        vertices, chosen = todo.pop()
        if low <= len(vertices) <= high:
            yield vertices, chosen
        for e in edges:
            if e not in chosen and (e[0] in vertices or e[1] in vertices):
                more, larger = chosen | {e}, vertices | set(e)
                if len(larger) <= high and more not in seen:
                    seen[more] = larger
                    todo.append((larger, more))


def all_connected(edges: list[Edge], low: int, high: int):
    """All connected edge sets with low to high vertices, each once, from every edge in turn without the edges before it."""
    for i, e in enumerate(edges):
        yield from connected_edge_sets(edges[i:], (frozenset(e), frozenset([e])), low, high)


def node_induced(edges: list[Edge], low: int, high: int):
    """All connected vertex sets with low to high vertices."""
    seen, todo = set(), [frozenset([v]) for e in edges for v in e]
    while todo:
        s = todo.pop()
        if s in seen:
            continue
        seen.add(s)
        if low <= len(s):
            yield s
        if len(s) < high:
            todo += [s | {w} for e in edges for v, w in (e, e[::-1]) if v in s and w not in s]


def graph_key(vertices: list[int], labels: dict[int, dict], edges: list[tuple[int, int, dict]], memo: dict | None = None) -> tuple[str, list[int]]:
    """Node-link JSON of the graph in canonical order, and that order. memo: results for graphs equal but for their ids."""
    at = {v: i for i, v in enumerate(vertices)}
    text = lambda d: json.dumps(d, sort_keys=True, ensure_ascii=False) if d else "{}"
    graph = (tuple(tuple(labels[v].items()) for v in vertices), tuple((at[s], at[t], *e.items()) for s, t, e in edges)) if memo is not None else None
    found = memo.get(graph) if memo is not None else None
    if found is None:
        order = canonical_order([text(labels[v]) for v in vertices], [(at[s], at[t], text(e)) for s, t, e in edges])
        place = {v: i for i, v in enumerate(order)}
        nodes = [{"id": place[i], **labels[v]} for i, v in enumerate(vertices)]
        links = [{"source": place[at[s]], "target": place[at[t]], **e} for s, t, e in edges]
        out = {"directed": True, "graph": {}, "links": sorted(links, key=lambda x: (x["source"], x["target"])), "multigraph": False, "nodes": sorted(nodes, key=lambda x: x["id"])}
        found = (text(out), order)
        if memo is not None:
            if len(memo) > 100_000:
                memo.clear()
            memo[graph] = found
    return found[0], [vertices[v] for v in found[1]]


_LABELS = ("word", "pos", "lemma", "wc", "root")


def _labels(token: dict) -> dict:
    out = {k: token[k] for k in _LABELS[:4] if token[k] is not None}
    return out | ({"root": "root"} if token["root"] else {})


def surroundings(tokens: list[dict], deps: list[dict], embedding: list[int], query: Pattern, max_size: int, keep_lemma: bool, memo: dict | None = None) -> set[tuple[str, str]]:
    """(gc key, gb key) of every star-like surrounding of an embedding: connected, with all of the query's vertices and edges and
    1 to max_size - len(query) vertices more, all adjacent to the query's in the sentence."""
    own = set(embedding)
    near = own | {d["dependent"] for d in deps if d["governor"] in own} | {d["governor"] for d in deps if d["dependent"] in own}
    relation = {(d["governor"], d["dependent"]): d["relation"] for d in deps if d["governor"] in near and d["dependent"] in near}
    labels = {t["position"]: _labels(t) for t in tokens if t["position"] in near}
    needed = frozenset((embedding[s], embedding[t]) for s, t, _ in query.edges)
    out = set()
    outside = ("wc", "lemma") if keep_lemma else ("wc",)
    for vertices, edges in connected_edge_sets(sorted(relation), (frozenset(own), needed), len(own) + 1, min(max_size, len(near))):
        gc, gb = {}, {}
        for v in vertices:
            if v in own:
                named = query.vertices[embedding.index(v)]
                gc[v] = {k: x for k, x in labels[v].items() if k in named} | {"query": "A"}
                gb[v] = {k: x for k, x in gc[v].items() if k not in ("word", "pos", "lemma", "root")}
            else:
                gc[v] = gb[v] = {k: x for k, x in labels[v].items() if k in outside}
        links = [(s, t, {"relation": relation[s, t]}) for s, t in sorted(edges)]
        order = sorted(vertices)
        out.add((graph_key(order, gc, links, memo)[0], graph_key(order, gb, links, memo)[0]))
    return out


def delexicalize(query: Pattern) -> Pattern:
    """Without words and lemmas, of which the query must have one."""
    if not any(k in v for v in query.vertices for k in ("word", "lemma")):
        raise ValueError("the query needs a word or lemma")
    return query.without("word", "lemma")


def larger_structures(corpus: Corpus, query: Pattern, max_size: int = 7, min_coocc: int = 5, keep_lemma: bool = False, digits: int | None = None) -> DataFrame:
    """Structures around the query that are associated with its lexical items: larger_structure, method, o11, r1, c1, n, inconsistent, measures.

    n: units of the query without lexical items; r1: those that have them; c1: those with the surrounding; o11: with both.
    """
    marked = query.marked("focus_point")
    query = query.without("focus_point")
    focus = marked[0] if marked else query.focus_point()
    bare, names = delexicalize(query), columns(query)
    found = embeddings(corpus, bare)
    lexical = extend(corpus, Pattern(query.vertices, (), None), names, found, tuple(names)).select("sentence_id", *names).withColumn("fa", F.lit(True))
    found = found.join(lexical, ["sentence_id", *names], "left").withColumn("fa", F.coalesce("fa", F.lit(False)))
    # The embedding that tells which vertex plays which part of a set of vertices is the smallest one.
    sets = found.groupBy("sentence_id", F.expr(f"array_sort(array({', '.join(names)}))").alias("set")).agg(F.min(F.array(*names)).alias("m"), F.max("fa").alias("fa"))
    rows = sets.groupBy("sentence_id").agg(F.collect_list(F.struct("set", "m", "fa")).alias("sets")).join(corpus.only(sets).graphs(), "sentence_id")

    def run(batches):
        import hashlib

        import pyarrow as pa

        memo: dict = {}
        hashed = lambda text: hashlib.md5(text.encode()).digest()
        for b in batches:
            out = []
            for r in b.to_pylist():
                for s in r["sets"]:
                    out += [(r["sentence_id"], s["set"], hashed(c), hashed(g), c) for c, g in surroundings(r["tokens"], r["dependencies"], s["m"], query, max_size, keep_lemma, memo)]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["sentence_id", "set", "gc", "gb", "text"])

    # Kept, as both keys are counted from it. Keys are hashes; texts are only fetched for what is reported.
    around = _once(rows.mapInArrow(run, "sentence_id long, set array<int>, gc binary, gb binary, text string"))
    flagged = found.withColumn("set", F.expr(f"array_sort(array({', '.join(names)}))"))
    units = by_unit(flagged, names, f"m{focus}", "fa", "set")
    totals = units.groupBy("method", "sentence_id", "unit").agg(F.max("fa").alias("fa")).groupBy("method").agg(F.count("*").alias("n"), F.expr("count_if(fa)").alias("a"))
    unit_a = units.groupBy("method", "sentence_id", "unit").agg(F.max("fa").alias("ua"))
    # Structures in enough sentences with the lexical items, before anything else is counted.
    lexical_sets = flagged.where("fa").select("sentence_id", "set").distinct()
    often = around.join(lexical_sets, ["sentence_id", "set"], "left_semi").groupBy("gc", "gb").agg(F.count_distinct("sentence_id").alias("s")).where(F.col("s") >= min_coocc)
    often = _once(often.select("gc", "gb"))
    near_c = around.select("sentence_id", "set", "gc", "gb").join(often, ["gc", "gb"], "left_semi")
    near_b = around.select("sentence_id", "set", "gb").join(often.select("gb").distinct(), "gb", "left_semi").distinct()
    c = units.where("fa").join(near_c, ["sentence_id", "set"]).groupBy("gc", "gb", "method").agg(F.count_distinct("sentence_id", "unit").alias("o11"))
    b = units.join(near_b, ["sentence_id", "set"]).select("gb", "method", "sentence_id", "unit").distinct().join(unit_a, ["method", "sentence_id", "unit"])
    b = b.groupBy("gb", "method").agg(F.count("*").alias("b"), F.expr("count_if(ua)").alias("ab"))
    texts = around.select("gc", "text").join(often.select("gc").distinct(), "gc", "left_semi").groupBy("gc").agg(F.min("text").alias("text"))
    rows = c.join(b, ["gb", "method"]).join(F.broadcast(totals), "method").join(texts, "gc")  # four rows in totals
    rows = rows.withColumn("inconsistent", F.col("ab") - F.col("o11"))
    half = F.col("inconsistent").cast("double") / 2
    rows = rows.select(F.col("text").alias("larger_structure"), "method", "o11", (F.col("a") - half).alias("r1"), (F.col("b") - half).alias("c1"), "n", "inconsistent")
    return with_measures(rows, digits=digits)


def _star_keys(n: int, center: int, edges: tuple[tuple[int, int, str], ...]) -> tuple:
    """edge_key, edge_center, skeleton_key, skeleton_center, length, degrees, relations of a star on vertices 0..n-1."""
    every, none = list(range(n)), {x: {} for x in range(n)}

    def keyed(links: list[tuple[int, int, dict]]) -> tuple[str, int]:
        key, order = graph_key(every, none, links)
        with_center = lambda x: graph_key(every, none | {x: {"c": 1}}, links)[0]
        own = with_center(center)
        # Equivalent vertices share the smallest place.
        return key, min(i for i, x in enumerate(order) if with_center(x) == own)

    degrees = sorted((sum(x in e[:2] for e in edges) for x in every), reverse=True)
    return (*keyed([(s, t, {"relation": r}) for s, t, r in edges]), *keyed([(s, t, {}) for s, t, _ in edges]), n, " ".join(map(str, degrees)), " ".join(sorted(r for _, _, r in edges)))


def star_rows(corpus: Corpus, max_vertices: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """A row for every star-like subgraph: sentence_id, center, pos, wc, edge_key, edge_center, skeleton_key, skeleton_center, length, degrees, relations.

    places: (sentence_id, position) of the centres that are asked for; all without it.
    """

    some = places is not None

    def run(batches):
        import pyarrow as pa

        memo: dict = {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                asked = set(r["asked"]) if some else None
                relation = {(d["governor"], d["dependent"]): d["relation"] for d in r["dependencies"]}
                for t in r["tokens"]:
                    v = t["position"]
                    if asked is not None and v not in asked:
                        continue
                    near = {v} | {y for x, y in relation if x == v} | {x for x, y in relation if y == v}
                    edges = sorted(e for e in relation if e[0] in near and e[1] in near)
                    for vertices, chosen in connected_edge_sets(edges, (frozenset([v]), frozenset()), 2, min(max_vertices or len(near), len(near))):
                        if not all((v, x) in chosen or (x, v) in chosen for x in vertices if x != v):
                            continue
                        order = sorted(vertices)
                        at = {x: i for i, x in enumerate(order)}
                        star = (len(order), at[v], tuple((at[x], at[y], relation[x, y]) for x, y in sorted(chosen)))
                        if star not in memo:
                            if len(memo) > 100_000:
                                memo.clear()
                            memo[star] = _star_keys(*star)
                        out.append((r["sentence_id"], v, t["pos"], t["wc"], *memo[star]))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["sentence_id", "center", "pos", "wc", "edge_key", "edge_center", "skeleton_key", "skeleton_center", "length", "degrees", "relations"])

    rows = corpus.graphs()
    if some:
        asked = places.groupBy("sentence_id").agg(F.collect_set("position").alias("asked"))
        rows = corpus.only(asked).graphs().join(asked, "sentence_id")
    return rows.mapInArrow(run, "sentence_id long, center int, pos string, wc string, edge_key string, edge_center int, skeleton_key string, skeleton_center int, length int, degrees string, relations string")


def star_frequencies(stars: DataFrame, skeleton: bool = False, labels: bool = False) -> DataFrame:
    """Frequency of each star and of its centres (AGG25, AGG26); labels: with the centre's pos and wc in the key."""
    kind = "skeleton" if skeleton else "edge"
    keys = [f"{kind}_key", f"{kind}_center", "length", "degrees", *([] if skeleton else ["relations"]), *(["pos", "wc"] if labels else [])]
    return stars.groupBy(*keys).agg(F.count("*").alias("star_freq"), F.count_distinct("sentence_id", "center").alias("center_freq"))


def edge_to_skeleton(stars: DataFrame) -> DataFrame:
    return stars.groupBy("edge_key", "edge_center").agg(F.array_sort(F.collect_set(F.struct("skeleton_key", "skeleton_center"))).alias("skeletons"))


def _once(df: DataFrame) -> DataFrame:
    """Computed once: a checkpoint where the session has a folder for them, else kept."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def connected_subgraphs(corpus: Corpus, low: int, high: int, edges: int | None = None) -> DataFrame:
    """(sentence_id, vertices, edges): all connected subgraphs with low to high vertices (and so many edges), by joins.

    Level by level: sets of k + 1 edges are sets of k edges with one more edge at one of their vertices, deduplicated. Each level
    is computed once.
    """
    deps = corpus.dependencies.selectExpr("sentence_id", "governor g", "dependent d")
    now = deps.selectExpr("sentence_id", "array_sort(array(g, d)) vertices", "array(struct(g, d)) edges").distinct()
    out, most = now, edges or high * (high - 1)
    for _ in range(1, most):
        more = now.join(deps, "sentence_id").where("array_contains(vertices, g) or array_contains(vertices, d)").where("not array_contains(edges, struct(g, d))")
        more = more.selectExpr("sentence_id", "array_sort(array_union(vertices, array(g, d))) vertices", "array_sort(array_append(edges, struct(g, d))) edges")
        now = _once(more.where(F.size("vertices") <= high).distinct())
        if edges is None and now.limit(1).count() == 0:
            break
        out = out.unionAll(now)
    out = out.where((F.size("vertices") >= low) & (F.size("vertices") <= high))
    return out.where(F.size("edges") == edges) if edges else out


def connected_vertex_sets(corpus: Corpus, low: int, high: int) -> DataFrame:
    """(sentence_id, vertices, edges): the node-induced connected subgraphs with low to high vertices, by joins: sets of k + 1 vertices are
    sets of k with one more neighbour; edges are all between them."""
    ends = corpus.dependencies.selectExpr("sentence_id", "inline(array(named_struct('v', governor, 'w', dependent), named_struct('v', dependent, 'w', governor)))").distinct()
    now = corpus.tokens.selectExpr("sentence_id", "array(position) vertices")
    out = now
    for _ in range(1, high):
        more = now.selectExpr("sentence_id", "vertices", "explode(vertices) v").join(ends, ["sentence_id", "v"]).where("not array_contains(vertices, w)")
        now = _once(more.selectExpr("sentence_id", "array_sort(array_append(vertices, w)) vertices").distinct())
        out = out.unionAll(now)
    out = out.where((F.size("vertices") >= low) & (F.size("vertices") <= high))
    deps = corpus.dependencies.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("governor").alias("g"), F.col("dependent").alias("d")))).alias("deps"))
    out = out.join(deps, "sentence_id", "left")
    return out.selectExpr("sentence_id", "vertices", "filter(coalesce(deps, array()), e -> array_contains(vertices, e.g) and array_contains(vertices, e.d)) edges")
