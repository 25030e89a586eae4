"""Classifiers, search, decontamination, URLs, mixing and chats."""

import math
import random

import numpy as np
import pytest

from dependra.llm import chat, decontaminate, language, mixing, neighbours, quality, queries, urls
from dependra.llm.common import Scratch
from tests.helpers import oracle, rows_of
from tests.llm import cases


def test_language_forward_algorithm():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    m = language.PieceModel(pieces, ["x", "y"])
    rng = np.random.default_rng(0)
    m.p[:-1] = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    at = {p: i for i, p in enumerate(sorted(pieces, key=pieces.index))}

    def total(s, lang):
        if not s:
            return 1.0
        return sum((m.p[at[s[:k]], lang] if s[:k] in at else m.p[m.n, lang] if k == 1 else 0) * total(s[k:], lang) for k in range(1, min(m.longest, len(s)) + 1))

    words = ["a", "ab", "abba", "zab", "b", "aabbab"]
    got = m.log_likelihoods(words)
    for w, row in zip(words, got):
        assert np.allclose(row, [math.log(total("▁" + w, k)) for k in (0, 1)])
    assert np.isfinite(m.log_likelihoods(["ab" * 3000])).all()


def test_language(spark):
    docs = cases.documents(spark)
    rng = random.Random(1)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60))
    known = spark.createDataFrame([(i, make(["ka", "ro", "mi"] if i % 2 else ["sch", "ung", "ein"]), "p" if i % 2 else "q") for i in range(60)], "doc_id long, text string, lang string")
    model = language.fit_languages(known.where("doc_id < 40"))
    got = language.identify_language(known, model).where("doc_id >= 40").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.text): r for r in language.identify_language(docs, model).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for (_, t), r in out.items() if not t or not any(c.isalpha() for c in t))
    none = language.fit_languages(cases.empty(known))
    assert {r.lang_pred for r in language.identify_language(docs, none).collect()} == {"und"}
    assert language.identify_language(cases.empty(docs), model).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, cases.prose(i, 50) if i % 3 else " ".join(w + "### !!" for w in cases.prose(i, 50).upper().split()), int(i % 3 > 0)) for i in range(300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (999, 0), (1, 1), (1, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels.where("doc_id is null or doc_id < 200"))
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert np.mean([got[i].predicted == q for i, _, q in rows if i >= 200]) > 0.95
    odd = quality.score_quality(cases.documents(spark), model)
    assert odd.count() == 22 and odd.where("score between 0 and 1").count() == 22
    for few in (cases.empty(labels), labels.where("quality = 1")):
        assert quality.score_quality(docs, quality.fit_quality(docs, few)).where("score between 0 and 1").count() == 300
    assert quality.score_quality(cases.empty(docs), model).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16)) * 3
    v = (centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    v[7] *= 5
    v[300:400] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (None, v[0].tolist()), (2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [1.0, None] * 8), (2040, [1.0, 2.0]), (2050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 key", "2 cell").repartition(4)
    got = neighbours.nearest(df, "vec_id % 10 = 0", Scratch(spark), k=8, dims=6, cell_rows=200, query_rows=40).toPandas()
    w, hit = v.astype(np.float64), []
    for q, g in got.groupby("query_id"):
        s = w @ w[q]
        order = [i for i in sorted(range(1500), key=lambda i: (-s[i], i)) if i != q][:8]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 9)) and np.allclose(g.score, s[g.vec_id])
        assert all(a > b or (a == b and x < y) for a, b, x, y in zip(g.score, g.score[1:], g.vec_id, g.vec_id[1:]))
        hit.append(len(set(g.vec_id) & set(order)) / 8)
    assert set(got.query_id) == set(range(0, 1500, 10)) and np.mean(hit) > 0.95
    # 300 is a copy of 7: its nearest are the smallest ids of the copies.
    assert list(got[got.query_id == 300].sort_values("rank").vec_id) == [7, *range(301, 308)]
    few = neighbours.nearest(df.where("vec_id < 5"), "vec_id = 0", Scratch(spark))
    assert few.count() == 4 and neighbours.nearest(cases.empty(df), "vec_id = 0", Scratch(spark)).count() == 0


def test_cells():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 4)), np.zeros((50, 4))])
    cells = neighbours.Cells(x[::3], 37)
    inside = lambda c: ((cells.low[c] <= x) & (x < cells.high[c])).all(axis=1)
    assert (np.array([inside(c) for c in range(len(cells.low))]).argmax(axis=0) == cells.of(x)).all() and len(cells.low) == 37
    assert (neighbours.Cells(np.zeros((5, 3)), 4).of(x[:, :3]) == 0).all()


def test_recall_in_many_blocks(spark):
    """embeddings against brute force, with so few rows in blocks and cells that there are many of both, and parts of cells."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = neighbours.nearest(df, "vec_id % 20 = 0", Scratch(spark), cell_rows=300, query_rows=20, sample_rows=96).toPandas()
    hit, order = [], np.argsort(ids)
    ids, v = ids[order], v[order]
    for q, g in got.groupby("query_id"):
        s = v @ v[np.searchsorted(ids, q)]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit.append(len(set(g.vec_id) & set(best)) / 20)
        g = g.sort_values("rank")
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], rtol=0, atol=1e-9) and list(g["rank"]) == list(range(1, 21))
    assert len(hit) == (ids % 20 == 0).sum() and np.mean(hit) > 0.97


def shuffled(spark) -> int:
    """Rows that have been written to shuffles in this session so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    store = sc.statusStore()
    jobs = store.jobsList(None)
    stages = {s for i in range(jobs.size()) for s in (lambda ids: [ids.apply(j) for j in range(ids.size())])(jobs.apply(i).stageIds())}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_queries_are_not_copied_to_cells(spark, tmp_path):
    """Vectors without clusters, so that every query asks for all of 100 cells: rows shuffled follow the points, not queries times cells."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(10_000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    path = str(tmp_path / "v")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(path)
    before = shuffled(spark)
    got = neighbours.nearest(spark.read.parquet(path), "vec_id % 10 = 0", Scratch(spark), cell_rows=100, query_rows=50).toPandas()
    assert 10_000 <= shuffled(spark) - before < 5 * 10_000
    hit = []
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hit.append(len(set(g.vec_id) & set(np.argsort(-s)[:20])) / 20)
        assert np.allclose(g.sort_values("rank").score, s[g.sort_values("rank").vec_id], rtol=0, atol=1e-12)
    assert len(hit) == 1000 and np.mean(hit) > 0.97


def test_passes():
    """Every query is in one pass; cells that are too large for one are divided."""
    made = neighbours._passes([(3, 4), (0, 5), (1, 5), (7, 25), (9, 1), (8, 10)], 10)
    assert made == ["cell between 0 and 1", "cell between 3 and 3", *(f"cell = 7 and pmod(xxhash64(key, 5), 3) = {i}" for i in range(3)), "cell between 8 and 8", "cell between 9 and 9"]
    assert neighbours._passes([], 10) == [] and neighbours._passes([(0, 1), (5, 1)], 10) == ["cell between 0 and 5"]


def test_equal_products_of_different_vectors(spark):
    """Different vectors of one product with the query: the smaller id first."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(i % 7), float(i % 5)]) for i in range(1, 60)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", Scratch(spark), k=70).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 60)) and {r.score for r in got} == {0.5}


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 10) - 18.307) < 1e-3 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_decontamination(spark):
    items = [(i, cases.prose(1000 + i, 12 + 3 * i)) for i in range(40)] + [(50, None), (51, ""), (52, "word"), (None, cases.prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 score", "2 df")
    docs = [(100 + i, cases.prose(i, 90)) for i in range(60)]
    want = set()
    for k in range(0, 40, 4):
        head, tail = cases.prose(500 + k, 37 * k + 5), cases.prose(600 + k, 50)
        docs.append((k, f"{head}. {items[k][1].upper()}! {tail}"))
        want.add((k, k))
    docs += [(None, None), (300, ""), (301, items[5][1][: len(items[5][1]) // 2]), (302, items[8][1]), (302, items[8][1])]
    want |= {(302, 8)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "3 item_id")
    for words in (200_000, 300):
        got = decontaminate.find_leaks(df, bench, Scratch(spark), shard_words=words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        kept = decontaminate.drop_leaking(df, bench, Scratch(spark), shard_words=words)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(df, cases.empty(bench), Scratch(spark)).count() == 0 and decontaminate.find_leaks(cases.empty(df), bench, Scratch(spark)).count() == 0


def test_block_max_misses_nothing():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(3, 90))) for i in range(70)]
    df = {}
    for _, ws in items:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    texts = [rng.choices(vocabulary, k=rng.randint(0, 200)) for _ in range(40)] + [["strange"] * 70, []]
    for threshold, block in ((0.35, 16), (0.6, 4), (0.2, 1), (0.9, 100)):
        index = decontaminate.BlockMaxIndex(items, df, 70, 30.0, threshold=threshold, block=block)
        names, want = {k: x for x, k in index.terms.items()}, {}
        for t, ws in enumerate(texts):
            for begin in range(0, len(ws), 32):
                here = set(ws[begin : begin + 96])
                for item, impacts in index.units:
                    score = sum(v for term, v in impacts.items() if names[term] in here)
                    if score >= threshold:
                        want[t, item] = max(want.get((t, item), 0), score)
        got = {(t, i): x for t, i, _, x in index.search(texts)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and (want or threshold > 0.5)


def test_urls(spark):
    rows = ["http://A.Example.com/de/1?x", "https://example.com/dex", "http://x.example.net/en/5#t", "http://net/a", "http://b.net", "http://b.net/", "ftp://u.org/fr/", "http://u.org/de/3", None, "", "nothing", "a://b://c/d", "http://evilnet/x", "http://example.comm/de/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(0, rows[0], "h")], "page_id long, url string, html string").selectExpr("*", "'x' host", "1 n", "2 template")
    got = {r.page_id: r for r in urls.filter_urls(df, Scratch(spark)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (0, 1, 2, 3)] == [("a.example.com", "/de/1", "example.com/de/"), ("example.com", "/dex", None), ("x.example.net", "/en/5", "example.net/en/"), ("net", "/a", "net/")]
    assert [got[i].rule for i in (4, 5, 6, 7)] == [None, "net/", "org/fr/", None] and (got[11].host, got[11].path) == ("b:", "//c/d")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (8, 9, 10)) and got[12].rule is None and got[13].rule is None
    assert {got[i].verdict for i in (0, 3, 5)} == {"block"} and {got[i].verdict for i in (2, 6, 8)} == {"allow"}
    assert urls.filter_urls(df, Scratch(spark)).count() == 15 and urls.filter_urls(cases.empty(df), Scratch(spark)).count() == 0
    assert urls.filter_urls(df, Scratch(spark), rules=()).where("verdict = 'block'").count() == 0
    # Rules that only block: what has no label is allowed, but for http://b.net, of one template with http://b.net/.
    only = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, Scratch(spark), rules=(("block", "net", "/"),)).collect()}
    assert all(v == ("block" if rule or i == 4 else "allow") for i, (rule, v) in only.items()) and only[3] == ("net/", "block")


def test_url_templates_carry_verdicts_on(spark):
    rows = [(i, f"http://h.com/ads/item{i}name/{i}") for i in range(200)] + [(300 + i, f"http://h.com/wiki/page{i}") for i in range(200)]
    rules = tuple(("block", "h.com", f"/ads/item{i}name/") for i in range(120)) + tuple(("allow", "h.com", f"/wiki/page{i}") for i in range(60))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), Scratch(spark), rules).collect()
    assert {r.verdict for r in got if r.page_id < 200} == {"block"} and {r.verdict for r in got if r.page_id >= 300} == {"allow"}
    assert {r.template for r in got if r.page_id < 200} == {"/ads/*/<n>"}


def test_url_branches_merge_at_all_levels(spark):
    """Two labelled branches with whole subtrees alike become one; their pages without a label get its verdict."""
    rows, rules = [], []
    for branch, kind in (("promo", "block"), ("offers", "block"), ("news", "allow"), ("blog", "allow")):
        for leaf in ("red", "blue"):
            for i in range(30):
                rows.append((len(rows), f"https://s.org/{branch}/{leaf}/{i}"))
        rules += [(kind, "s.org", f"/{branch}/red/")]
    rows += [(len(rows), "https://s.org/promo/green/1"), (len(rows) + 1, "https://other.org/promo/red/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.filter_urls(pages, Scratch(spark), tuple(rules)).collect()
    where = lambda *xs: {(r.template, r.verdict) for r in got if any(f"/{x}/" in r.path for x in xs) and r.host == "s.org"}
    assert where("promo/red", "offers/red") == {("/{+}/red/<n>", "block")} and {v for _, v in where("news/red", "blog/red")} == {"allow"}
    assert {r.verdict for r in got if r.host == "other.org" or "green" in r.path} == {"allow"}


def test_mixing(spark, tmp_path):
    docs = cases.documents(spark).selectExpr("*", "5 copy")
    out = mixing.mix_sources(docs)
    assert set(docs.columns) | {"mix_key"} == set(out.columns)
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys)
    big = spark.range(30000).selectExpr("id doc_id", "if(id % 10 = 0, 'rare', 'often') source", "'t' text")
    share = {r.source: r.n for r in mixing.mix_sources(big, spark.createDataFrame([("rare", 1.0), ("often", 1.0), ("none", 2.0)], "source string, weight double"), total=60000).groupBy("source").agg({"*": "count"}).toDF("source", "n").collect()}
    assert abs(share["rare"] - 30000) < 1000 and abs(share["often"] - 30000) < 1000
    many = mixing.mix_sources(big.where("id < 20"), total=20000).count()
    assert abs(many - 20000) < 700
    assert mixing.mix_sources(cases.empty(docs)).count() == 0


def test_chats(spark):
    conv = {1: ["u:a", "s:b"], 2: ["u:a", "s:b", "u:c"], 3: ["u:a", "s:b", "u:c"], 4: ["u:x"], 5: ["u:a", "s:c"], 6: ["u:a"], None: ["u:n"], 8: ["u:", "s:b"]}
    rows = [(c, 10 * t + (c or 0), x[0], x[2:] or None) for c, ts in conv.items() for t, x in enumerate(ts)]
    rows += [rows[0], (9, None, None, None), (9, 1, "u", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 b", "8 pos", "9 x").repartition(3)
    for block in (1024, 2):
        got = chat.format_chats(df, Scratch(spark), block).collect()
        assert {(r.conv_id, r.n_turns, r.n_absorbed) for r in got} == {(2, 3, 3), (4, 1, 0), (5, 2, 1), (None, 1, 0), (8, 2, 0), (9, 2, 0)}
        whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part))
        assert whole == "<|im_start|>u\na<|im_end|>\n<|im_start|>s\nb<|im_end|>\n<|im_start|>u\nc<|im_end|>\n"
    assert chat.format_chats(cases.empty(df), Scratch(spark)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    assert isinstance(queries.ORACLES[name], str)
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), oracle(queries.ORACLES[name], "sf0.001")
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got, got.columns) == rows_of(want, want.columns)


def test_op1_and_op10_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = language.op1_language(spark, sf).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and len(got) == len(docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = quality.op10_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.9


def test_long_words(spark):
    """Words of 45 letters, and of 5,000, teach and are told apart."""
    rng = random.Random(4)
    word = lambda syllables, n: "".join(rng.choice(syllables) for _ in range(n))
    both = {"p": ["ka", "ro", "mi"], "q": ["ub", "esh", "int"]}
    rows = [(i, " ".join(word(both[la], 5000 if i < 4 else 20) for _ in range(2 if i < 4 else 6)), la) for i in range(40) for la in [("p", "q")[i % 2]]]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(known.where("doc_id < 30"))
    assert all(r.lang_pred == r.lang and r.score > 0.99 for r in language.identify_language(known, model).where("doc_id < 4 or doc_id >= 30").collect())
    m = language.PieceModel(["▁", "a", "b", "ab", "aba"], ["x"])
    assert np.allclose(m._forward(np.array([[ord(c) for c in "▁" + "abab" * 30]], np.uint64), 7), m._forward(np.array([[ord(c) for c in "▁" + "abab" * 30]], np.uint64)))


def test_op1_by_brute_force(spark):
    """The whole query again in plain Python: its model's probabilities, every segmentation by a recursion, every text."""
    from functools import cache

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_languages(docs.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    vocabulary = {p: i for i, p in enumerate(language.vocabulary())}

    @cache
    def log_p(word):
        sums = [np.ones(len(model.langs))]
        for j in range(1, len(word) + 1):
            now = np.zeros(len(model.langs))
            for i in range(max(0, j - model.longest), j):
                if word[i:j] in vocabulary or j == i + 1:
                    now += sums[i] * model.p[vocabulary.get(word[i:j], model.n)]
            sums.append(now)
        return np.log(sums[-1])

    got = {r.doc_id: r for r in language.op1_language(spark, sf).collect()}
    for i, text in cases.texts(docs):
        found = language.LETTERS.findall((text or "").lower())
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        s = sum(log_p("▁" + w) for w in found)
        assert got[i].lang_pred == model.langs[int(s.argmax())] and abs(got[i].score - 1 / np.exp(s - s.max()).sum()) < 1e-6
        assert got[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 3 == 1)
    assert len(got) == docs.count()


def plain_score(model, text):
    """A score from sizes of blocks compressed one by one, each of which gives its text back, and the formula written out."""
    import zstandard

    data = (text or "").encode()
    f = [1.0, 0, 0, 0, 0, 0]
    if data:
        sizes = []
        for held in (model.good, model.bad):
            kind = zstandard.DICT_TYPE_AUTO if held[:4] == (0xEC30A437).to_bytes(4, "little") else zstandard.DICT_TYPE_RAWCONTENT
            made = zstandard.ZstdCompressionDict(held, dict_type=kind)
            made.precompute_compress(level=model.level)
            total = 0
            for i in range(0, len(data), model.block):
                part = data[i : i + model.block]
                frame = zstandard.ZstdCompressor(level=model.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(part)
                assert zstandard.ZstdDecompressor(dict_data=made).decompress(frame, max_output_size=len(part)) == part
                total += len(frame)
            sizes.append(total)
        g, b = sizes
        diff, ratio, size = (b - g) / (b + g), min(b, g) / len(data), math.log(1 + len(data)) / 8
        f[1:] = diff, diff * size, min(ratio, 1.5), math.exp(-8 * ratio), size
    return 1 / (1 + math.exp(-sum(x * w for x, w in zip(f, model.weights))))


def test_op10_by_brute_force(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, quality.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    for i, text in cases.texts(docs):
        score = plain_score(model, text)
        assert abs(got[i].score - score) < 1e-9 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].predicted == int(score >= 0.3)
    assert len(got) == docs.count()


def test_samples(spark):
    from dependra.llm.common import sampled

    df = spark.range(20000).selectExpr("id", "case when id % 2 = 0 then 'often' when id < 100 then 'rare' when id % 10 = 1 then null else concat('v', id) end kind")
    n = {r.kind: r["count"] for r in sampled(df, "kind", 300, "id", 3).groupBy("kind").count().collect()}
    assert 220 < n["often"] < 380 and n["rare"] == 50 and None not in n and len(n) > 7000
