"""Near duplicates, lines and substrings against brute force on awkward tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dependra.llm import lines, neardup, substrings
from dependra.llm.common import Scratch, component_labels
from tests.llm import cases


def components(docs, size, percent=80):
    """doc_id -> (sizes, component), all pairs compared on full sets."""
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted(((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in sets))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    docs = cases.documents(spark)
    rows = neardup.near_duplicates(docs, Scratch(spark), size).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in rows)
    assert got == components(cases.texts(docs), size)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert neardup.near_duplicates(cases.empty(docs), Scratch(spark)).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = cases.prose(1, 50), cases.prose(2, 50)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (4, ""), (None, a), (5, cases.prose(3, 50))], "doc_id long, text string")
    rows = neardup.near_duplicates(docs, Scratch(spark), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4), (0, 0), (5, 5)])


def test_large_groups_of_edits(spark):
    """Chains and clouds around the threshold, more than a block holds."""
    import random

    rng, rows = random.Random(8), []
    for g in range(3):
        base = cases.prose(g, 60).split()
        for k in range(300):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((g * 1000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, Scratch(spark), 2).collect())
    assert got == components(rows, 2)


@pytest.mark.parametrize("percent", [30, 55, 95])
def test_other_similarities(spark, percent):
    """Bands and filters follow the threshold."""
    import random

    rng, rows = random.Random(percent), []
    for g in range(12):
        base = cases.prose(g, 80).split()
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 34)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((g * 1000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, Scratch(spark), 2, percent / 100).collect())
    assert got == components(rows, 2, percent)


def test_drop_near_duplicates(spark):
    docs = cases.documents(spark)
    out = neardup.drop_near_duplicates(docs, Scratch(spark))
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.where("doc_id is not null").collect())
    assert ids == sorted({i for i, _, c in components(cases.texts(docs), 5) if i == c and i >= 0})


def test_sketches():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = neardup.sketch([a, b, np.union1d(a, b), a[:0]])
    assert (neardup.merge(s[0], s[1]) == s[2]).all() and (s[3] == 0).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert neardup.plausible(s[:1], s[1:2], np.array([900.0]), np.array([900.0]), 0.8)[0]
    assert not neardup.plausible(s[:1], s[1:2], np.array([900.0]), np.array([500.0]), 0.8)[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e} | {50})], "id long")
    got = {r.id: r.component for r in component_labels(Scratch(spark), nodes, spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got[4] == 1 and got[10] == 8 and got[20] == 20 and got[50] == 50 and got[140] == 100


def test_lines(spark):
    docs = cases.documents(spark)
    where = defaultdict(set)
    for i, t in cases.texts(docs):
        for x in (t or "").split("\n"):
            k = x.strip(lines.BLANK)
            if len(k) >= 40 and i is not None:
                where[k.encode().lower()].add(i)
    often = {k: max(v) for k, v in where.items() if len(v) >= 5}
    assert often
    want = []
    for i, t in cases.texts(docs):
        ls = (t or "").split("\n")
        stay = [x for x in ls if i is None or often.get(x.strip(lines.BLANK).encode().lower(), i) == i]
        want.append((i or 0, len(ls), len(ls) - len(stay), "\n".join(stay)))
    for hot in (2000, 3):
        out = lines.drop_repeated_lines(docs, Scratch(spark), batches=5, hot=hot)
        assert set(docs.columns) <= set(out.columns)
        assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == sorted(want)
    assert lines.drop_repeated_lines(cases.empty(docs), Scratch(spark)).count() == 0


def test_runs_are_levelled(spark):
    runs = lines.LineRuns(Scratch(spark), 2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, b"x"), (i, b"%d" % i)], "doc_id long, key binary"))
    assert sorted(runs.levels) == [0, 2]
    assert [(bytes(r.key), r.n_docs, r.max_doc) for r in runs.frequent(5).collect()] == [(b"x", 5, 4)]
    # The anti-join decides what a run holds: a key lies in one run only, its later sightings in the log.
    assert [sorted(bytes(r.key) for r in t.collect()) for t in runs.runs()] == [[b"4"], [b"0", b"1", b"2", b"3", b"x"]]
    assert [[bytes(r.key) for r in t.collect()] for _, t in runs.log] == [[b"x"]] * 4
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def removed(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((i if i is not None else -1, len(d), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram,most,hot", [(200, 64, 20_000, 2000), (30, 8, 20_000, 3), (200, 64, 2, 2000)])
def test_substrings(spark, length, gram, most, hot):
    docs = cases.documents(spark).where("doc_id is null or doc_id <> 15" if length == 30 else "true")
    out = substrings.drop_repeated_substrings(docs, Scratch(spark), length, gram, most, hot)
    assert set(docs.columns) <= set(out.columns)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == removed(cases.texts(docs), length)


def test_substrings_of_nothing(spark):
    assert substrings.drop_repeated_substrings(cases.empty(cases.documents(spark)), Scratch(spark)).count() == 0


def test_suffix_order():
    import random

    rng = random.Random(3)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))] + [0]
        assert list(substrings.suffix_order(text)) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [[5] * 1_000_000 + [6], [6] + [5] * 100_000, [5, 6] * 50_000, [3 + i // 500 for i in range(100_000)], [*range(3, 200)] * 500])
def test_suffix_order_is_linear(text):
    """Texts whose Lyndon words are as long as they are: copies or comparisons of words would take minutes."""
    import time

    began = time.time()
    order = np.array(substrings.suffix_order([*text, 0]))
    assert time.time() - began < 20 and order[0] == len(text) and len(set(order.tolist())) == len(text) + 1
    # In order: by first symbol and then by the place of what follows.
    place = np.argsort(order)
    key = np.array([*text, 0])[order[1:]] * (len(text) + 2) + place[order[1:] + 1]
    assert (np.diff(key) > 0).all()


def test_suffix_array():
    import random

    rng = random.Random(3)
    for _ in range(300):
        strings = [bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abc\x00", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
        data, order = substrings.suffix_array(strings)
        marks = np.cumsum([len(s) + 1 for s in strings]) - 1
        symbols = [1 if i in marks else c + 2 for i, c in enumerate(data)]
        assert [symbols[i:] for i in order] == sorted(symbols[i:] for i in range(len(data)))
    assert substrings.suffix_array([])[0] == b""
