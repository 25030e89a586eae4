"""Command-line tools, streaming and generators."""

import json

import pytest

from dependra import cli
from dependra.operators import counting
from dependra.plans import compiler
from dependra.plans.pattern import Pattern, parse, split_association
from dependra.sources import formats, generate
from dependra.sources.corpus import Corpus
from dependra.streaming import ingest

QUERY = {"graph": {}, "nodes": [{"id": 0, "query": "AB", "pos": "p1"}, {"id": 1, "query": "A"}, {"id": 2, "query": "B"}], "links": [{"source": 0, "target": 1, "relation": "r00000"}, {"source": 0, "target": 2, "relation": "r00001"}]}


@pytest.fixture(scope="module")
def bank(spark):
    return generate.random_treebank(spark, 60, vocabulary=6, relations=3, distribution="normal").persist()


def test_generator(spark, bank):
    again = generate.random_treebank(spark, 60, vocabulary=6, relations=3, distribution="normal")
    assert bank.tokens.exceptAll(again.tokens).count() == 0 and bank.tokens.where("outdegree > 10").count() == 0
    from dependra.operators.graphs import sensible_sentences

    assert sensible_sentences(bank).count() == 60
    sizes = generate.lengths(spark.range(500).withColumnRenamed("id", "sentence_id"), "uniform", 2, 5)
    assert {r.length for r in sizes.collect()} == {2, 3, 4, 5}
    narrow = generate.random_treebank(spark, 30, degrees="powerlaw", max_outdegree=2, low=12, high=20)
    assert narrow.tokens.where("outdegree > 2").count() == 0 and sensible_sentences(narrow).count() == 30
    few = generate.random_treebank(spark, 40, underspecified=1.0, degrees="zipf", root=False)
    assert few.tokens.where("word <> '.+' or root").count() == 0


def test_split_tree():
    tree = Pattern(({"word": "a"}, {"word": "b"}, {"word": "c"}), ((0, 1, {"relation": "x"}), (1, 2, {"relation": "y"})))
    for seed in range(8):
        a, b, r1, c1, n = generate.split_tree(tree, seed)
        assert len(a) + len(b) == 4 and len(r1) == len(c1) == 3 and n.is_purely_structural()


def test_tools(spark, bank, tmp_path):
    formats.write_conllu(bank, str(tmp_path / "text"))
    (tmp_path / "q.json").write_text(json.dumps([QUERY]))
    (tmp_path / "c.json").write_text(json.dumps([{"nodes": [{"id": 0, "collo_item": True, "pos": "p1"}, {"id": 1}], "links": [{"source": 0, "target": 1}]}]))
    (tmp_path / "v.json").write_text(json.dumps([{"nodes": [{"id": 0, "collo_A": True}, {"id": 1, "collo_B": True}], "links": [{"source": 0, "target": 1, "relation": "r00000"}]}]))
    (tmp_path / "s.json").write_text(json.dumps([{"nodes": [{"id": 0, "lemma": "w00000"}]}]))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("convert", tmp_path / "text", "--db", tmp_path / "db", "-f", "conllu", "--max-sentences", 50)
    assert spark.read.parquet(str(tmp_path / "db/sentences")).count() == 50
    run("association_strength", tmp_path / "text", tmp_path / "q.json", "-f", "conllu", "-o", tmp_path / "o1")
    wide = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o1"))
    n = {r.method: r.n for r in counting.association(bank, split_association(parse(QUERY))).collect()}
    assert int(wide.first()["embeddings_n"]) == n["embeddings"] and len(wide.columns) == 33
    run("collexeme_analysis", tmp_path / "db", tmp_path / "c.json", "-o", tmp_path / "o2")
    run("covarying_collexemes", tmp_path / "db", tmp_path / "v.json", "-c", "word", "-o", tmp_path / "o3")
    run("associated_structures", tmp_path / "db", tmp_path / "s.json", "--max-size", 3, "--min-coocc", 1, "-o", tmp_path / "o4")
    run("draw", tmp_path / "db", "-o", tmp_path / "o5")
    for o in ("o2", "o3", "o4", "o5"):
        assert spark.read.text(str(tmp_path / o)).count() > 3


def test_streaming(spark, bank, tmp_path):
    text = [r.value for r in formats.to_conllu(bank).orderBy("ord").collect()]
    source = tmp_path / "in"
    source.mkdir()
    q = split_association(parse(QUERY))
    for i, part in enumerate((text[:25], text[25:])):
        (source / f"{i}.conllu").write_text("\n\n".join(part) + "\n")
        ingest.ingest_conllu(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"), {"q": q}).awaitTermination()
    want = {r.method: tuple(r) for r in counting.contingency_of(bank, q).collect()}
    got = {r.method: tuple(r) for r in ingest.running_totals(spark, str(tmp_path / "out"), "q").collect()}
    assert got == want
    held = ingest.ingested(spark, str(tmp_path / "out"))
    assert compiler.embeddings(held, q.n).count() == want["embeddings"][4]
    assert isinstance(held, Corpus)


def test_near_trees(spark):
    from dependra.sources.generate import near_treebank, random_treebank

    trees = random_treebank(spark, 300, seed=3)
    near = near_treebank(trees, 0.5, seed=4)
    extra = near.dependencies.where("relation = 'extra'")
    n = trees.tokens.where("position > 0").count()
    assert 0.1 * n < extra.count() < 0.5 * n and extra.where("governor >= dependent").count() == 0
    assert near.dependencies.groupBy("sentence_id", "governor", "dependent").count().where("count > 1").count() == 0
    assert near.dependencies.where("relation <> 'extra'").count() == trees.dependencies.count() == n
    assert near.tokens.agg({"indegree": "sum"}).first()[0] == near.dependencies.count()
    assert near_treebank(trees, 0.0).dependencies.count() == n
