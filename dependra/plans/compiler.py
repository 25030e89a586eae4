"""Compiles a pattern into joins over a corpus.

Every join has sentence_id in its key, so corpora dealt or bucketed by it are joined where they lie. The labels of each vertex are
tested on the token table before it is joined; a vertex without tests is taken from its edges alone. Joins start at the
vertex with the most tests and follow a spanning tree. Inequalities are only written for pairs of vertices that labels
don't tell apart. Negated relations are left-anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dependra.plans.pattern import LABELS, LISTS, Pattern
from dependra.sources.corpus import Corpus


def label_test(column: str, value, negated: bool, regexp: bool = False) -> Column:
    if column == "root":  # the label is there or not
        yes = value in ("root", True)
        return F.col("root") if yes != negated else ~F.col("root") if yes else F.lit(False)
    if regexp:
        return ~F.col(column).rlike(value) if negated else F.col(column).rlike(value)
    return (F.col(column) != value) if negated else (F.col(column) == value)


def vertex_tests(vertex: dict, regexp: bool = False) -> list[Column]:
    return [label_test(k.removeprefix("not_"), v, k.startswith("not_"), regexp) for k, v in vertex.items() if k.removeprefix("not_") in LABELS]


def edge_test(edge: dict) -> Column:
    tests = [label_test("relation", edge[k], k != "relation") for k in ("relation", "not_relation") if k in edge]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def candidates(corpus: Corpus, vertex: dict, name: str = "position", degrees: tuple[int, int] = (0, 0), regexp: bool = False) -> DataFrame:
    """(sentence_id, name): the tokens that a vertex can stand for by its labels, forbidden relations and least degrees.

    regexp: labels are regular expressions that are searched for.
    """
    rows = reduce(lambda df, t: df.where(t), vertex_tests(vertex, regexp), corpus.tokens)
    for kind, least in zip(("indegree", "outdegree"), degrees):
        if least:
            rows = rows.where(F.col(kind) >= least)
    rows = rows.select("sentence_id", F.col("position").alias(name))
    for kind, end in (("not_indep", "dependent"), ("not_outdep", "governor")):
        if vertex.get(kind):
            bad = corpus.dependencies.where(F.col("relation").isin(list(vertex[kind]))).select("sentence_id", F.col(end).alias(name))
            rows = rows.join(bad, ["sentence_id", name], "left_anti")
    return rows


def _tested(vertex: dict) -> bool:
    return bool(vertex_tests(vertex)) or any(vertex.get(k) for k in LISTS)


def _apart(a: dict, b: dict) -> bool:
    """Whether labels alone keep two vertices apart."""
    same = any(k in a and k in b and a[k] != b[k] for k in LABELS)
    return same or any(a.get(k) is not None and a.get(k) == b.get(f"not_{k}") or b.get(k) is not None and b.get(k) == a.get(f"not_{k}") for k in LABELS)


def extend(corpus: Corpus, pattern: Pattern, names: list[str], rows: DataFrame | None = None, bound: tuple[str, ...] = (), outside: tuple[str, ...] = ()) -> DataFrame:
    """rows with a column of names for each vertex, one row an embedding.

    bound: names that rows has already. outside: columns of rows that new vertices must differ from.
    """
    todo_edges, done = list(pattern.edges), set(bound)
    todo_labels = {v for v in range(len(pattern)) if _tested(pattern.vertices[v])}
    degree = lambda v: (sum(1 for _, t, _ in pattern.edges if t == v), sum(1 for s, _, _ in pattern.edges if s == v))

    def differ(df: DataFrame, new: list[int]) -> DataFrame:
        for v in new:
            others = [names.index(x) for x in done if x in names and x != names[v]]
            for w in others:
                if not _apart(pattern.vertices[v], pattern.vertices[w]):
                    df = df.where(F.col(names[v]) != F.col(names[w]))
            for x in outside:
                if x != names[v] and x not in names:
                    df = df.where(F.col(names[v]) != F.col(x))
        return df

    def labels(df: DataFrame | None, v: int) -> DataFrame:
        todo_labels.discard(v)
        some = candidates(corpus, pattern.vertices[v], names[v], degree(v))
        return some if df is None else df.join(some, ["sentence_id", names[v]] if names[v] in done else "sentence_id")

    for v in sorted(todo_labels):
        if names[v] in done:
            rows = labels(rows, v)
    while True:
        edge = next((e for e in todo_edges if names[e[0]] in done and names[e[1]] in done), None) or next((e for e in todo_edges if names[e[0]] in done or names[e[1]] in done), None)
        if edge is None:
            left = [v for v in range(len(pattern)) if names[v] not in done]
            if not left:
                break
            v = max(left, key=lambda v: (len(vertex_tests(pattern.vertices[v])), v in todo_labels, -v))
            incident = [e for e in todo_edges if v in e[:2]]
            if v in todo_labels or not incident:
                rows = labels(rows, v)
                done.add(names[v])
                rows = differ(rows, [v])
                continue
            edge = incident[0]
        s, t, e = edge
        todo_edges.remove(edge)
        deps = corpus.dependencies.where(edge_test(e)).select("sentence_id", F.col("governor").alias(names[s]), F.col("dependent").alias(names[t]))
        rows = deps if rows is None else rows.join(deps, ["sentence_id", *[names[x] for x in (s, t) if names[x] in done]])
        new = [x for x in (s, t) if names[x] not in done]
        for x in new:
            done.add(names[x])
            if x in todo_labels:
                rows = labels(rows, x)
            rows = differ(rows, [x])
    return rows


def columns(pattern: Pattern) -> list[str]:
    return [f"m{i}" for i in range(len(pattern))]


def embeddings(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """(sentence_id, m0, m1, ...): all injective maps of the pattern's vertices that keep its edges and labels."""
    names = columns(pattern)
    return extend(corpus, pattern, names).select("sentence_id", *names)


def with_extension(corpus: Corpus, found: DataFrame, base: Pattern, larger: Pattern, flag: str, keep_outside: bool = True) -> DataFrame:
    """found (embeddings of base) with a flag: whether larger embeds with their common vertices where base has them and every
    other vertex outside (anywhere else than the common ones, without keep_outside)."""
    own = columns(base)
    at = {vid: own[i] for i, vid in enumerate(base.vids)}
    names = [at.get(vid, f"x{vid}") for vid in larger.vids]
    bound = tuple(x for x in own if x in names)
    hits = extend(corpus, larger, names, found.select("sentence_id", *own), bound, tuple(own) if keep_outside else ())
    hits = hits.select("sentence_id", *own).distinct().withColumn(flag, F.lit(True))
    return found.join(hits, ["sentence_id", *own], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def candidate_sentences(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """Sentences that have a candidate for every vertex."""
    each = []
    for v in range(len(pattern)):
        degree = (sum(1 for _, t, _ in pattern.edges if t == v), sum(1 for s, _, _ in pattern.edges if s == v))
        each.append(candidates(corpus, pattern.vertices[v], "p", degree).select("sentence_id").distinct())
    return reduce(lambda a, b: a.join(b, "sentence_id", "left_semi"), each)
