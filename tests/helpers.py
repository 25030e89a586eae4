"""Small corpora, and matchers by brute force."""

import glob
import itertools

import duckdb

from dependra.sources.corpus import DEPENDENCIES, Corpus, with_degrees


def corpus(spark, *sentences):
    """sentences: (vertices, edges); vertices: dicts with labels, edges: (governor, dependent, relation)."""
    t, d = [], []
    for i, (vertices, edges) in enumerate(sentences):
        t += [(i, p, *(v.get(k) for k in ("word", "pos", "lemma", "wc")), v.get("root") == "root") for p, v in enumerate(vertices)]
        d += [(i, g, x, r) for g, x, r in edges]
    tokens = spark.createDataFrame(t, "sentence_id long, position int, word string, pos string, lemma string, wc string, root boolean")
    deps = spark.createDataFrame(d, DEPENDENCIES)
    return Corpus(with_degrees(tokens, deps).select("sentence_id", "position", "word", "pos", "lemma", "wc", "indegree", "outdegree", "root"), deps)


def fits(label, query):
    for k, v in query.items():
        key = k.removeprefix("not_")
        if key not in ("word", "pos", "lemma", "wc", "root", "relation"):
            continue
        have = label.get(key)
        if key == "root":
            if (have == "root") != (k == "root"):
                return False
        elif have is None or (have == v) != (k == key):
            return False
    return True


def matches(sentence, pattern, fixed=None, outside=()):
    """All injective maps; fixed: vertex to position; outside: positions barred to the others."""
    vertices, edges = sentence
    relation = {(g, d): r for g, d, r in edges}
    out = set()
    for m in itertools.permutations(range(len(vertices)), len(pattern)):
        if fixed and any(m[q] != p for q, p in fixed.items()) or any(p in outside and q not in (fixed or {}) for q, p in enumerate(m)):
            continue
        ok = all(fits(vertices[p], pattern.vertices[q]) for q, p in enumerate(m))
        for q, p in enumerate(m):
            v = pattern.vertices[q]
            ok = ok and not any(d == p and r in v.get("not_indep", ()) for _, d, r in edges) and not any(g == p and r in v.get("not_outdep", ()) for g, _, r in edges)
        ok = ok and all((m[s], m[t]) in relation and fits({"relation": relation[m[s], m[t]]}, e) for s, t, e in pattern.edges)
        if ok:
            out.add(m)
    return out


def contingency(sentences, query):
    """method -> (o11, r1, c1, n, inconsistent), by set algebra."""
    totals = {m: [0, 0.0, 0.0, 0, 0] for m in ("embeddings", "subgraphs", "focus_points", "sentences")}
    for s in sentences:
        n = matches(s, query.n)
        held = {}
        for name, p in (("c", query.c), ("a", query.a), ("b", query.b)):
            held[name] = {m for m in n if matches(s, p, {q: m[query.n.vids.index(v)] for q, v in enumerate(p.vids) if v in query.n.vids}, set(m))}
        held["n"] = n
        unit = {"embeddings": lambda m: m, "subgraphs": frozenset, "focus_points": lambda m: m[query.focus], "sentences": lambda m: 0}
        for method, key in unit.items():
            x = {k: {key(m) for m in v} for k, v in held.items()}
            inc = len((x["a"] & x["b"]) - x["c"])
            for i, v in enumerate((len(x["c"]), len(x["a"]) - inc / 2, len(x["b"]) - inc / 2, len(x["n"]), inc)):
                totals[method][i] += v
    return {k: tuple(v) for k, v in totals.items()}


def oracle(sql, sf):
    c = duckdb.connect()
    for f in glob.glob(f"/root/testdata/{sf}/*.parquet"):
        c.sql(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    return c.sql(sql).df()


def rows_of(df, columns):
    import pandas as pd

    return sorted(tuple("∅" if pd.api.types.is_scalar(x) and pd.isna(x) else str(x) for x in r) for r in df[sorted(columns)].astype(object).itertuples(index=False))
