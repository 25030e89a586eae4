"""Graph operators on corpora: admission, reachability, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dependra.sources.corpus import Corpus

MAX_OUTDEGREE, MAX_EGO_EDGES = 10, 18


def _shapes(corpus: Corpus) -> DataFrame:
    """A row for each sentence: sentence_id, n, roots, outdegree (the largest), loose (tokens but roots without a governor), positions of roots, edges."""
    t = corpus.tokens.groupBy("sentence_id").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("root"), F.col("position"))).alias("roots"), F.max("outdegree").alias("outdegree"),
        F.expr("count_if(not root and indegree = 0)").alias("loose"), F.max("position").alias("last"))
    d = corpus.dependencies.groupBy("sentence_id").agg(F.collect_list("governor").alias("governors"), F.collect_list("dependent").alias("dependents"))
    return t.join(d, "sentence_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("governors", "dependents")})


def _hops(batch) -> tuple:
    """For a record batch of shapes: where each sentence's places begin, hops of every place (-1: not reached), ends of edges; all sentences at once."""
    import numpy as np

    first = np.concatenate([[0], np.cumsum(batch.column("last").to_numpy() + 1)])
    flat = lambda c: (batch.column(c).flatten().to_numpy(), batch.column(c).value_lengths().to_numpy())
    sizes = flat("governors")[1]
    own = np.repeat(first[:-1], sizes)
    g, d = own + flat("governors")[0], own + flat("dependents")[0]
    roots, n = flat("roots")
    hops = np.full(first[-1], -1)
    hops[np.repeat(first[:-1], n) + roots] = step = 0
    while True:
        new = d[(hops[g] == step) & (hops[d] < 0)]
        if not len(new):
            return first, hops, g, d, sizes
        step += 1
        hops[new] = step


def reachable(corpus: Corpus) -> DataFrame:
    """(sentence_id, position, hops): what a sentence's roots reach; the sentences of a record batch go step by step together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                first, hops, *_ = _hops(b)
                at = np.flatnonzero(hops >= 0)
                row = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([b.column("sentence_id").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), pa.array(hops[at].astype(np.int32))], names=["sentence_id", "position", "hops"])

    return _shapes(corpus).select("sentence_id", "last", "roots", "governors", "dependents").mapInArrow(run, "sentence_id long, position int, hops int")


def neighbourhood(corpus: Corpus, sets: DataFrame, positions: str) -> DataFrame:
    """sets with column neighbourhood: the positions of the array column positions and all that touch them."""
    ends = corpus.dependencies.selectExpr("sentence_id", "inline(array(named_struct('a', governor, 'b', dependent), named_struct('a', dependent, 'b', governor)))")
    key = sets.select("sentence_id", positions).distinct()
    near = key.withColumn("a", F.explode(positions)).join(ends, ["sentence_id", "a"]).groupBy("sentence_id", positions).agg(F.collect_set("b").alias("near"))
    out = sets.join(near, ["sentence_id", positions], "left")
    return out.withColumn("neighbourhood", F.expr(f"array_sort(array_union({positions}, coalesce(near, array())))")).drop("near")


def ego_edges(corpus: Corpus) -> DataFrame:
    """(sentence_id, position, edges): edges within a token and its neighbours."""
    d = corpus.dependencies
    ends = d.selectExpr("sentence_id", "inline(array(named_struct('v', governor, 'w', dependent), named_struct('v', dependent, 'w', governor), named_struct('v', governor, 'w', governor), named_struct('v', dependent, 'w', dependent)))").distinct()
    inner = ends.join(d, "sentence_id").where("w = governor").select("sentence_id", "v", "governor", "dependent")
    inner = inner.join(ends.selectExpr("sentence_id", "v", "w dependent"), ["sentence_id", "v", "dependent"], "left_semi")
    return inner.groupBy("sentence_id", F.col("v").alias("position")).agg(F.count("*").alias("edges"))


def sensible_sentences(corpus: Corpus) -> DataFrame:
    """sentence_id of admitted sentences: one root, which reaches every token; out-degrees and edges within neighbourhoods within their bounds.

    Roots, degrees and tokens without a governor are counted by Spark; only numbers of places go to Python, where the sentences of a
    record batch are searched together. A neighbourhood can only be too dense if the sentence has so many edges.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            first, hops, g, d, sizes = _hops(b)
            ok = np.add.reduceat(hops >= 0, first[:-1]) == b.column("n").to_numpy()
            begins = np.concatenate([[0], np.cumsum(sizes)])
            for i in np.flatnonzero(ok & (sizes > MAX_EGO_EDGES)):
                edges = list(zip(g[begins[i] : begins[i + 1]].tolist(), d[begins[i] : begins[i + 1]].tolist()))
                near: dict[int, set] = {}
                for x, y in edges:
                    near.setdefault(x, {x}).add(y)
                    near.setdefault(y, {y}).add(x)
                ok[i] = all(sum(x in own and y in own for x, y in edges) <= MAX_EGO_EDGES for own in near.values())
            yield pa.RecordBatch.from_arrays([b.column("sentence_id").filter(pa.array(ok))], names=["sentence_id"])

    some = _shapes(corpus).where(f"size(roots) = 1 and loose = 0 and outdegree <= {MAX_OUTDEGREE}")
    return some.select("sentence_id", "n", "last", "roots", "governors", "dependents").mapInArrow(run, "sentence_id long")


def admitted(corpus: Corpus) -> Corpus:
    return corpus.only(sensible_sentences(corpus))
