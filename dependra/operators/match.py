"""Existence, rooted and fixed matches, candidate sets, arc consistency, and SQL text of patterns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dependra.plans.compiler import candidates, columns, edge_test, embeddings, extend
from dependra.plans.pattern import LABELS, Pattern, from_adjacency
from dependra.sources import formats
from dependra.sources.corpus import Corpus


def subsumed(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """sentence_id of the sentences in which the pattern occurs."""
    return embeddings(corpus, pattern).select("sentence_id").distinct()


def matrix_embeddings(matrices: DataFrame, query: list[list[dict]]) -> DataFrame:
    """(sentence_id, m0, m1, ...): embeddings of an adjacency matrix in each of matrices (sentence_id, matrix)."""
    return embeddings(formats.from_adjacency(matrices), from_adjacency(query))


def rooted(corpus: Corpus, pattern: Pattern, focus: int) -> DataFrame:
    """(sentence_id, focus): the tokens that the focus can be."""
    return embeddings(corpus, pattern).select("sentence_id", F.col(f"m{focus}").alias("focus")).distinct()


def rooted_at(corpus: Corpus, pattern: Pattern, focus: int, places: DataFrame) -> DataFrame:
    """Those of places (sentence_id, focus), tokens of the corpus, at which the pattern occurs; the search starts from them."""
    names = columns(pattern)
    seeds = places.select("sentence_id", F.col("focus").alias(names[focus])).distinct()
    found = extend(corpus, pattern, names, seeds, (names[focus],)).select("sentence_id", F.col(names[focus]).alias("focus")).distinct()
    return places.join(found, ["sentence_id", "focus"], "left_semi")


def count_fixed(corpus: Corpus, pattern: Pattern, vertex: int, places: DataFrame) -> DataFrame:
    """(sentence_id, position, embeddings): how many embeddings have the vertex at each of places (sentence_id, position), tokens of the
    corpus; the search starts from them."""
    names = columns(pattern)
    seeds = places.select("sentence_id", F.col("position").alias(names[vertex])).distinct()
    found = extend(corpus, pattern, names, seeds, (names[vertex],)).groupBy("sentence_id", F.col(names[vertex]).alias("position")).agg(F.count("*").alias("embeddings"))
    return places.join(found, ["sentence_id", "position"], "left").fillna(0, ["embeddings"])


def large_enough(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """sentence_id of the sentences that have as many tokens and edges as the pattern."""
    return corpus.sizes().where((F.col("n_tokens") >= len(pattern)) & (F.col("n_deps") >= len(pattern.edges))).select("sentence_id")


def candidate_sets(corpus: Corpus, pattern: Pattern, consistent: bool = True) -> DataFrame:
    """(sentence_id, vertex, position): what each vertex can stand for by itself; consistent: and with a partner for each of its edges."""
    degree = lambda v: (sum(t == v for _, t, _ in pattern.edges), sum(s == v for s, _, _ in pattern.edges))
    own = [candidates(corpus, pattern.vertices[v], "position", degree(v)) for v in range(len(pattern))]
    out = list(own)
    if consistent:
        for s, t, e in pattern.edges:
            deps = corpus.dependencies.where(edge_test(e))
            links = deps.join(own[s].withColumnRenamed("position", "governor"), ["sentence_id", "governor"], "left_semi").join(own[t].withColumnRenamed("position", "dependent"), ["sentence_id", "dependent"], "left_semi")
            out[s] = out[s].join(links.select("sentence_id", F.col("governor").alias("position")), ["sentence_id", "position"], "left_semi")
            out[t] = out[t].join(links.select("sentence_id", F.col("dependent").alias("position")), ["sentence_id", "position"], "left_semi")
    return reduce(lambda a, b: a.unionAll(b), [x.select("sentence_id", F.lit(v).alias("vertex"), "position") for v, x in enumerate(out)])


def folded(found: DataFrame, pattern: Pattern) -> DataFrame:
    """Embeddings folded to one row a sentence: the sorted set of positions of each vertex."""
    return found.groupBy("sentence_id").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns(pattern)])


def _quote(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def pattern_sql(pattern: Pattern, tokens: str = "tokens", dependencies: str = "dependencies") -> str:
    """One SELECT over the two tables that gives the embeddings: inner joins with NOT EXISTS for forbidden relations."""
    names = range(len(pattern))
    where, sources = [], [f"{tokens} t{v}" for v in names] + [f"{dependencies} d{i}" for i in range(len(pattern.edges))]
    where += [f"t{v}.sentence_id = t0.sentence_id" for v in names if v]
    for v, labels in enumerate(pattern.vertices):
        for k, x in labels.items():
            key, negated = k.removeprefix("not_"), k.startswith("not_")
            if key == "root":
                where.append(f"{'not ' if negated else ''}t{v}.root")
            elif key in LABELS:
                where.append(f"t{v}.{key} {'<>' if negated else '='} {_quote(x)}")
        for k, end in (("not_indep", "dependent"), ("not_outdep", "governor")):
            if labels.get(k):
                where.append(f"not exists (select 1 from {dependencies} z where z.sentence_id = t{v}.sentence_id and z.{end} = t{v}.position and z.relation in ({', '.join(map(_quote, labels[k]))}))")
    for i, (s, t, e) in enumerate(pattern.edges):
        where += [f"d{i}.sentence_id = t0.sentence_id", f"d{i}.governor = t{s}.position", f"d{i}.dependent = t{t}.position"]
        where += [f"d{i}.relation {'=' if k == 'relation' else '<>'} {_quote(x)}" for k, x in e.items() if k in ("relation", "not_relation")]
    where += [f"t{a}.position <> t{b}.position" for a, b in combinations(names, 2)]
    return f"select t0.sentence_id, {', '.join(f't{v}.position m{v}' for v in names)} from {', '.join(sources)}" + (f" where {' and '.join(where)}" if where else "")


def breadth_first(corpus: Corpus, fragment: bool = False) -> DataFrame:
    """(sentence_id, position, rank): places in breadth-first order from the first root, children by relation and position.

    fragment: what has no root starts from the first place that reaches all others, else from all without a governor. Sentences without a
    start give no rows.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for sid, tokens, deps in zip(b.column("sentence_id").to_pylist(), b.column("tokens").to_pylist(), b.column("dependencies").to_pylist()):
                below: dict[int, list] = {}
                for d in deps:
                    below.setdefault(d["governor"], []).append((d["relation"], d["dependent"]))

                def walk(todo):
                    seen = {}
                    for v in todo:  # grows as it goes
                        if v not in seen:
                            seen[v] = len(seen)
                            todo += [x for _, x in sorted(below.get(v, ()))]  # noqa: B023
                    return seen

                start = [t["position"] for t in tokens if t["root"]][:1]
                if fragment and not start:
                    start = next(([t["position"]] for t in tokens if len(walk([t["position"]])) == len(tokens)), [])
                    governed = {d["dependent"] for d in deps}
                    start = start or [t["position"] for t in tokens if t["position"] not in governed]
                out += [(sid, v, i) for v, i in walk(start).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["sentence_id", "position", "rank"])

    return corpus.graphs().mapInArrow(run, "sentence_id long, position int, rank int")


def in_corpus_order(ranked: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """rows (sentence_id, column: an array of ranks) with the places that breadth_first() gave those ranks, in ascending order."""
    places = ranked.groupBy("sentence_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "position"))).alias("places__"))
    return rows.join(places, "sentence_id").withColumn(column, F.expr(f"array_sort(transform({column}, r -> places__[r]))")).drop("places__")


def subsets(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """df with column subset: a row for each subset of an array column with low to high elements, in the array's order.

    Subsets of one size more are made from those before by every later element, so that arrays may be of any length.
    """
    at = "i__"
    now = df.withColumn("subset", F.expr(f"filter({column}, x -> false)")).withColumn(at, F.lit(-1))
    out = now.where(F.lit(low <= 0))
    for size in range(1, high + 1):
        now = now.withColumn("j__", F.explode(F.expr(f"if(size({column}) > {at} + 1, sequence({at} + 1, size({column}) - 1), cast(array() as array<int>))")))
        now = now.withColumn("subset", F.expr(f"array_append(subset, {column}[j__])")).withColumn(at, F.col("j__")).drop("j__")
        if size >= low:
            out = out.unionAll(now)
    return out.drop(at)
