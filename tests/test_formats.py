"""Measures, tags, readers and writers."""

import json
import math

import pytest

from dependra.functions import measures, tags
from dependra.operators import counting
from dependra.plans import compiler
from dependra.plans.pattern import Pattern
from dependra.sources import formats
from dependra.sources.corpus import Corpus
from tests import helpers as H

GOLDEN = {
    "log_likelihood": (10.670468, 1.509775), "one_sided_log_likelihood": (-10.670468, 1.509775), "t_score": (-2.544395, 0.333333), "z_score": (-2.056656, 0.408248),
    "chi_squared": (6.883574, 0.75), "poisson_stirling_log": (-37.123002, -0.415037), "mutual_information": (-0.614044, 0.584963), "local_mi": (-14.123002, 0.584963),
    "mi2": (3.909518, 0.584963), "mi3": (8.433080, 0.584963), "odds_ratio_disc": (-0.891160, 1.584963), "relative_risk": (-0.692690, 1.0), "liddell": (-0.115242, 0.5),
    "delta_p_column": (-0.115242, 0.5), "delta_p_row": (-0.067570, 0.5), "minimum_sensitivity": (0.090909, 0.5), "geometric_mean": (0.130381, 0.707107), "dice": (0.122340, 0.666667), "jaccard": (0.065156, 0.5),
}


def test_measures(spark):
    rows = spark.createDataFrame([(23, 253, 123, 884), (1, 2, 1, 3)], "o11 int, r1 int, c1 int, n int")
    got = rows.select(*[measures.measure(m) for m in measures.MEASURES]).collect()
    for m, want in GOLDEN.items():
        assert tuple(round(r[m], 6) for r in got) == want, m
    assert len(measures.MEASURES) == 23
    assert round(rows.select(measures.Table().e11).first()[0], 6) == 35.202489


def test_measures_where_undefined(spark):
    rows = spark.createDataFrame([(0, 1, 1, 4), (0, 0, 0, 0), (1, 1, 1, 2), (5, 3, 3, 4)], "o11 int, r1 int, c1 int, n int")
    got = rows.select(*[measures.measure(m) for m in measures.MEASURES]).collect()
    assert got[0]["t_score"] is None and got[0]["mutual_information"] is None and got[0]["poisson_stirling_log"] is None
    assert got[1]["z_score"] is None and got[2]["relative_risk"] is None and got[3]["log_likelihood"] is None
    assert all(x is None or math.isfinite(x) for r in got for x in r)


def test_tags(spark):
    rows = [("%", "NN", "obj", None, "SYM"), ("nobody", "NN", "obj", None, "PRON"), ("to", "TO", "mark", "VB", "PART"), ("to", "TO", "mark", "NN", "ADP"), ("be", "VBZ", "cop", None, "AUX"), ("that", "DT", "nsubj", None, "PRON"),
            ("that", "DT", "det", None, "DET"), ("which", "WDT", "nsubj", None, "PRON"), ("not", "RB", "advmod", None, "PART"), ("--", "NFP", "x", None, "PUNCT"), (":-)", "NFP", "x", None, "SYM"), ("if", "IN", "mark", None, "SCONJ"), ("x", "FW", "x", None, "EX"), ("x", "??", "x", None, "_")]
    df = spark.createDataFrame(rows, "l string, t string, r string, g string, want string")
    got = df.select("want", tags.upos(df.l, df.t, df.r, df.g).alias("got"), tags.word_class(df.t).alias("wc")).collect()
    assert [r.got for r in got] == [r.want for r in got] and got[0].wc == "SUBST" and got[-1].wc == "UNKNOWN"


CONLLU = """# sent_id = a
1\tThey\tthey\tPRON\tPRP\t_\t2\tnsubj\t2:nsubj|4:nsubj\t_
2\tbuy\tbuy\tVERB\tVBP\t_\t0\troot\t0:root\t_
3\tand\tand\tCONJ\tCC\t_\t4\tcc\t4:cc\t_
4\tsell\tsell\tVERB\tVBP\t_\t2\tconj\t0:root|2:conj\t_
5\tbooks\tbook\tNOUN\tNNS\t_\t2\tobj\t2:obj|4:obj\t_
6\t.\t.\tPUNCT\t.\t_\t2\tpunct\t2:punct\t_

1-2\tdon't\t_\t_\t_\t_\t_\t_\t_\t_
1\tdo\tdo\tAUX\tVB\t_\t0\troot\t_\t_
2\tnot\tnot\tPART\tRB\t_\t1\tadvmod\t_\t_
"""


@pytest.mark.parametrize("make", [lambda t: t, lambda t: "\n\n" + t.replace("# sent_id = a", "#sent_id=a").replace("\n\n", "\r\n\t \n\r\n") + "\r\n \n\n"])
def test_conllu(spark, tmp_path, make):
    (tmp_path / "x.conllu").write_bytes(make(CONLLU).encode())
    c = formats.conllu_corpus(formats.read_conllu(spark, str(tmp_path / "x.conllu")))
    edges = sorted((r.governor, r.dependent, r.relation) for r in c.dependencies.where("governor > 0 or dependent <> 1 or relation <> 'advmod'").collect())
    assert edges == [(1, 0, "nsubj"), (1, 3, "conj"), (1, 4, "obj"), (3, 0, "nsubj"), (3, 2, "cc"), (3, 4, "obj")]
    assert sorted(r.lemma for r in c.tokens.collect()) == sorted(["they", "buy", "and", "sell", "book", "do", "not"])
    q = Pattern(({"wc": "VERB"}, {"wc": "NOUN"}), ((0, 1, {"relation": "obj"}),))
    assert {r.method: r.n for r in counting.method_counts(c, q, 0).collect()} == {"embeddings": 2, "subgraphs": 2, "focus_points": 2, "sentences": 1}
    assert {r.method: r.n for r in counting.method_counts(c, q, 1).collect()}["focus_points"] == 1
    assert formats.read_conllu(spark, str(tmp_path / "x.conllu")).where("startswith(original_id, 's-')").count() == 1


def test_cwb_round_trip(spark, tmp_path):
    import gzip

    text = '<s id="7" len="2">\n<g/>\nGo\tVB\tgo\tVERB\t|\t|obj(0,1)|\troot\nhome\tNN\thome\tNOUN\t|obj(-1\',0)|x(0,0)|punct(-1,0)|\t|\t\n</s>\n<sentence id=\'8\'>\n</sentence>\n'
    with gzip.open(tmp_path / "x.cwb.gz", "wt") as f:
        f.write(text)
    rows = formats.read_cwb(spark, str(tmp_path / "x.cwb.gz"))
    assert [r.original_id for r in rows.collect()] == ["7"]
    c = formats.cwb_corpus(rows)
    assert [(r.governor, r.dependent, r.relation) for r in c.dependencies.collect()] == [(0, 1, "obj")]
    out = formats.cwb_text(c).first().value
    assert out.split("\n")[1] == "Go\tVB\tgo\tVERB\t|\t|obj(0,1)|\troot"
    again = formats.cwb_corpus(formats.parse_cwb(spark.createDataFrame([(0, out)], "ord long, value string")))
    assert again.dependencies.count() == 1 and again.tokens.count() == 2


def test_json_adjacency_dot_chemical(spark, tmp_path):
    g = ([{"word": 'a"b', "lemma": "a", "pos": "X", "wc": "W", "root": "root"}, {"word": "b", "lemma": None, "pos": None, "wc": "W"}], [(0, 1, "x")])
    c = H.corpus(spark, g)
    for back in (formats.from_json(formats.to_json(c)), formats.from_adjacency(formats.to_adjacency(c))):
        assert [tuple(r) for r in back.dependencies.collect()] == [(0, 0, 1, "x")]
        assert {r.word for r in back.tokens.collect()} == {'a"b', "b"}
    assert json.loads(formats.to_json(c).first().graph)["links"] == [{"relation": "x", "source": 0, "target": 1}]
    assert '0 -> 1 [label="x"]' in formats.to_dot(c).first().value
    assert formats.to_chemical(c).first().value.split("\n")[0] == "t # " and "e 0 1 1" in formats.to_chemical(c).first().value
    c.write(str(tmp_path / "c"))
    assert compiler.embeddings(Corpus.read(spark, str(tmp_path / "c")), Pattern(({}, {}), ((0, 1, {}),))).count() == 1
    formats.write_tsv(counting.method_counts(c, Pattern(({},), ()), 0), str(tmp_path / "t"))
    formats.write_conllu(c, str(tmp_path / "conllu"))
    assert formats.conllu_corpus(formats.read_conllu(spark, str(tmp_path / "conllu"))).dependencies.count() == 1


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    H.corpus(spark, ([{"word": "a", "root": "root"}, {"word": "b"}], [(0, 1, "x")])).save("bank", 4, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = compiler.embeddings(Corpus.load(spark, "bank"), Pattern(({"word": "a"}, {"word": "b"}), ((0, 1, {}),)))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bank_tokens", "bank_dependencies"):
            spark.sql(f"drop table {t}")


def test_corenlp(spark, tmp_path):
    t = lambda i, w, p: {"index": i, "word": w, "lemma": w, "pos": p, "originalText": w, "after": " "}
    d = lambda g, x, r: {"governor": g, "dependent": x, "dep": r}
    data = {"sentences": [{"index": 0, "tokens": [t(1, "-LRB-", "-LRB-"), t(2, "go", "VB")], "basicDependencies": [d(0, 2, "ROOT"), d(2, 1, "a|b")], "enhancedPlusPlusDependencies": [d(0, 2, "ROOT"), d(2, 1, "a|b"), d(2, 2, "self")]}]}
    (tmp_path / "x.json").write_text(json.dumps(data))
    rows = formats.read_corenlp_json(spark, str(tmp_path / "x.json"))
    r = rows.first()
    assert r.rows[0] == ["1", "(", "(", "PUNCT", "-LRB-", "_", "2", "a|b", "2:a-pipe-b", "_"] and r.rows[1][7:9] == ["root", "0:root"]
    assert formats.conllu_corpus(rows).dependencies.count() == 1
    formats.write_corenlp_conllu(rows, str(tmp_path / "out"))
    xml = """<root><document><sentences><sentence id="1"><tokens><token id="1"><word>We</word><lemma>we</lemma><POS>PRP</POS></token><token id="2"><word>go</word><lemma>go</lemma><POS>VBP</POS></token></tokens>
<dependencies type="basic-dependencies"><dep type="x"><governor idx="2">go</governor><dependent idx="1">We</dependent></dep></dependencies>
<dependencies type="enhanced-plus-plus-dependencies"><dep type="root"><governor idx="0">ROOT</governor><dependent idx="2">go</dependent></dep><dep type="nsubj"><governor idx="2" copy="1">go</governor><dependent idx="1">We</dependent></dep></dependencies></sentence></sentences></document></root>"""
    (tmp_path / "x.xml").write_text(xml)
    rows = formats.read_corenlp_xml(spark, str(tmp_path / "x.xml"))
    assert rows.first().rows == [["We", "PRP", "we", "PRON", "|nsubj(1',0)|", "|", ""], ["go", "VBP", "go", "VERB", "|", "|nsubj(0',-1)|", "root"]]
    assert [(x.governor, x.dependent) for x in formats.cwb_corpus(rows).dependencies.collect()] == [(1, 0)]


def test_places_caps_bins(spark):
    rows = spark.range(10).selectExpr("id", "cast(id % 3 + 1 as int) size")
    got = {r.id: (r.place, r.before) for r in formats.placed(rows, "id", weight="size").collect()}
    assert got == {i: (i, sum(j % 3 + 1 for j in range(i))) for i in range(10)}
    assert sorted(r.id for r in formats.capped(rows, "id", max_tokens=6).collect()) == [0, 1, 2, 3]
    assert sorted(r.id for r in formats.capped(rows, "id", max_sentences=2).collect()) == [0, 1]
    assert formats.int_bins(1, 3, 10) == [1, 2, 3, 3] and formats.int_bins(0, 9, 3) == [0, 4, 8, 11]
    assert {r.batch for r in formats.batched(rows, "id", 4).collect()} == {0, 1, 2}
    assert formats.binned(rows.where("id < 0"), "id").count() == 0


def test_insert_ignore(spark, tmp_path):
    path = str(tmp_path / "db")
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    formats.insert_ignore(a, path, ["k"])
    formats.insert_ignore(spark.createDataFrame([(1, "z"), (2, "w")], "k int, v string"), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]


@pytest.mark.parametrize("size", [97, 300])
def test_sentences_over_block_ends(spark, tmp_path, size):
    """Files cut anywhere give the same sentences in the same order."""
    import random

    rng, want = random.Random(size), []
    for f in range(3):
        text = ""
        for i in range(12):
            rows = [f"{j}\tw{f}.{i}.{j}" + "x" * rng.choice([0, 0, 200]) for j in range(rng.randint(1, 6))]
            want.append((f"f{f}s{i}", rows))
            end = rng.choice(["\n", "\r\n"])
            text += end.join([f"# sent_id = f{f}s{i}", *rows]) + end + rng.choice(["\n", " \n", "\r\n", "\n\n\t\n"])
        (tmp_path / f"{f}.conllu").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r.original_id, ["\t".join(x) for x in r.rows]) for r in formats.read_conllu(spark, str(tmp_path)).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_bernoulli_sample(spark):
    rows = spark.range(20000)
    n = formats.sampled(rows, 0.25, 3).count()
    assert 4600 < n < 5400 and formats.sampled(rows, 0.25, 3).count() == n
    assert formats.sampled(rows, 0.0, 3).count() == 0 and formats.sampled(rows, 1.0, 3).count() == 20000
