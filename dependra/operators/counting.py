"""The four counting methods, and contingency tables with inconsistent units.

A unit is an embedding, a set of vertices (subgraph), a focus point or a sentence. It is inconsistent if A and B hold in
it but C doesn't; that takes half a unit from either marginal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dependra.functions.measures import with_measures
from dependra.plans.compiler import columns, embeddings, extend, with_extension
from dependra.plans.pattern import Association, Pattern
from dependra.sources.corpus import Corpus

METHODS = ("embeddings", "subgraphs", "focus_points", "sentences")


def unit_keys(names: list[str], focus: str) -> dict[str, str]:
    """SQL of each method's key within a sentence."""
    every = f"array({', '.join(names)})"
    return {"embeddings": every, "subgraphs": f"array_sort({every})", "focus_points": f"array({focus})", "sentences": "cast(array() as array<int>)"}


def by_unit(found: DataFrame, names: list[str], focus: str, *keep: str) -> DataFrame:
    """A row for each embedding and method: sentence_id, method, unit."""
    keys = unit_keys(names, focus)
    each = ", ".join(f"named_struct('method', '{m}', 'unit', {k})" for m, k in keys.items())
    return found.selectExpr("sentence_id", *keep, f"inline(array({each}))")


def method_counts(corpus: Corpus, pattern: Pattern, focus: int) -> DataFrame:
    """(method, n): how often the pattern occurs by each counting method; all from one pass over the embeddings."""
    found = embeddings(corpus, pattern)
    units = by_unit(found, columns(pattern), f"m{focus}").distinct()
    return _all_methods(units.groupBy("method").agg(F.count("*").alias("n")), ["n"])


def _all_methods(counts: DataFrame, names: list[str]) -> DataFrame:
    methods = counts.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    return methods.join(counts, "method", "left").fillna(0, names)


def contingency(flagged: DataFrame, names: list[str], focus: str, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, o11, r1, c1, n, inconsistent) from embeddings with the flags fa, fb, fc."""
    units = by_unit(flagged, names, focus, "fa", "fb", "fc").where(F.col("method").isin(list(methods)))
    units = units.groupBy("method", "sentence_id", "unit").agg(*[F.max(f).alias(f) for f in ("fa", "fb", "fc")])
    return _totals(units)


def _totals(units: DataFrame) -> DataFrame:
    sums = units.groupBy("method").agg(
        *[F.sum(F.expr(f"cast({f} as bigint)")).alias(n) for f, n in (("fc", "o11"), ("fa", "a"), ("fb", "b"))], F.count("*").alias("n"),
        F.sum(F.expr("cast(fa and fb and not fc as bigint)")).alias("inconsistent"))
    sums = _all_methods(sums, ["o11", "a", "b", "n", "inconsistent"])
    half = F.col("inconsistent").cast("double") / 2
    return sums.select("method", "o11", (F.col("a") - half).alias("r1"), (F.col("b") - half).alias("c1"), "n", "inconsistent")


def contingency_of(corpus: Corpus, query: Association) -> DataFrame:
    """The contingency table of the structures A and B: a row for each counting method."""
    found = embeddings(corpus, query.n)
    for p, flag in ((query.c, "fc"), (query.a, "fa"), (query.b, "fb")):
        found = with_extension(corpus, found, query.n, p, flag)
    return contingency(found, columns(query.n), f"m{query.focus}")


def association(corpus: Corpus, query: Association, digits: int | None = None) -> DataFrame:
    """The association of the structures A and B: a row for each counting method, with measures."""
    return with_measures(contingency_of(corpus, query), digits=digits)


# Counts of earlier definitions, kept as operators of their own. They refuse units that have C but not both A and B.


def _signatures(units: DataFrame) -> DataFrame:
    wrong = F.expr("if(fc and not (fa and fb), raise_error('inconsistent classification'), fc)")
    return _totals(units.withColumn("fc", wrong.cast("boolean")))


def isomorphism_counts(corpus: Corpus, query: Association) -> DataFrame:
    """Units are embeddings of N; A, B and C hold if they embed with the common vertices in their places and all others outside."""
    found = embeddings(corpus, query.n)
    for p, flag in ((query.c, "fc"), (query.a, "fa"), (query.b, "fb")):
        found = with_extension(corpus, found, query.n, p, flag)
    return _signatures(found.selectExpr("'embeddings' method", "fa", "fb", "fc")).where("method = 'embeddings'")


def edge_set_subgraphs(corpus: Corpus, query: Association) -> DataFrame:
    """Units are connected subgraphs (vertex and edge sets) that N's pattern covers; the vertices that A, B and C share with N
    lie anywhere in the unit, all others outside."""
    found = embeddings(corpus, query.n)
    names = columns(query.n)
    edges = [f"named_struct('s', m{s}, 't', m{t})" for s, t, _ in query.n.edges]
    key = f"array_sort(array({', '.join(edges)}))" if edges else "array(named_struct('s', m0, 't', m0))"
    units = found.selectExpr("sentence_id", f"{key} unit", f"array_sort(array({', '.join(names)})) vertices").distinct()
    for p, flag in ((query.c, "fc"), (query.a, "fa"), (query.b, "fb")):
        own = [f"y{i}" for i in range(len(p))]
        inner = [own[i] for i, v in enumerate(p.vids) if v in query.n.vids]
        hits = extend(corpus, p, own).select("sentence_id", *own).join(units, "sentence_id")
        for x in own:
            inside = F.expr(f"array_contains(vertices, {x})")
            hits = hits.where(inside if x in inner else ~inside)
        hits = hits.select("sentence_id", "unit").distinct().withColumn(flag, F.lit(True))
        units = units.join(hits, ["sentence_id", "unit"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return _signatures(units.withColumn("method", F.lit("subgraphs"))).where("method = 'subgraphs'")


def choke_points(corpus: Corpus, query: Association) -> DataFrame:
    """Units are focus points; A, B and C hold if they embed with the focus point in its place, wherever the rest lies."""
    units = embeddings(corpus, query.n).select("sentence_id", F.col(f"m{query.focus}").alias("f")).distinct()
    vid = query.n.vids[query.focus]
    for p, flag in ((query.c, "fc"), (query.a, "fa"), (query.b, "fb")):
        hits = embeddings(corpus, p).select("sentence_id", F.col(f"m{p.vids.index(vid)}").alias("f")).distinct().withColumn(flag, F.lit(True))
        units = units.join(hits, ["sentence_id", "f"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return _signatures(units.selectExpr("'focus_points' method", "sentence_id", "fa", "fb", "fc")).where("method = 'focus_points'")


def sentence_signatures(corpus: Corpus, query: Association) -> DataFrame:
    """Units are sentences with N; A, B and C hold if they embed anywhere in the sentence."""
    units = embeddings(corpus, query.n).select("sentence_id").distinct()
    for p, flag in ((query.c, "fc"), (query.a, "fa"), (query.b, "fb")):
        hits = embeddings(corpus, p).select("sentence_id").distinct().withColumn(flag, F.lit(True))
        units = units.join(hits, "sentence_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return _signatures(units.selectExpr("'sentences' method", "sentence_id", "fa", "fb", "fc")).where("method = 'sentences'")


def legacy_bundle(corpus: Corpus, query: Association) -> DataFrame:
    """The four counts of earlier definitions in one table."""
    parts = [f(corpus, query) for f in (choke_points, isomorphism_counts, edge_set_subgraphs, sentence_signatures)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge(*results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds up the contingency tables (method, o11, r1, c1, n, inconsistent) of parts of a corpus; by: columns that tell tables apart."""
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r)
    return both.groupBy(*by, "method").agg(*[F.sum(c).alias(c) for c in ("o11", "r1", "c1", "n", "inconsistent")])
