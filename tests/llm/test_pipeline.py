"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from dependra.llm import decontaminate, lines, mixing, neardup, quality
from dependra.llm.common import Scratch
from tests.llm import cases
from tests.llm.test_dedup import components
from tests.llm.test_scores import plain_score


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, scratch, kept = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = scratch.save(stage(spark, docs, sf), name)
        assert set(columns) <= set(docs.columns)
    rows = {n: {r.doc_id: r.text for r in d.collect()} for n, d in kept.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & set(rows["quality"])) >= 0.97 * len(good) and set(rows["lines"]) == set(rows["quality"])
    where = {}
    for i, t in rows["quality"].items():
        for x in t.split("\n"):
            if len(x.strip(lines.BLANK)) >= 40:
                where.setdefault(x.strip(lines.BLANK).lower(), set()).add(i)
    often = {k: max(v) for k, v in where.items() if len(v) >= 5}
    for i, t in rows["quality"].items():
        assert rows["lines"][i] == "\n".join(x for x in t.split("\n") if often.get(x.strip(lines.BLANK).lower(), i) == i)
    assert set(rows["near_duplicates"]) == {i for i, _, c in components(sorted(rows["lines"].items()), 5) if i == c}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.find_leaks(kept["near_duplicates"], bench, scratch).collect()}
    assert set(rows["decontamination"]) == set(rows["near_duplicates"]) - leaks
    # Mixing by its SQL, over what it was given.
    import duckdb

    held = kept["decontamination"].select("doc_id", "source", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", held)
    want = sorted(con.sql(f"select doc_id, copy from ({mixing.OP8_SQL})").df().itertuples(index=False, name=None))
    assert sorted((r.doc_id, r.copy) for r in kept["mixing"].collect()) == want
    # Quality by plain compression of whole texts.
    source = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(source, quality.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    for i, t in cases.texts(source):
        assert (plain_score(model, t) >= 0.3) == (i in rows["quality"])
    assert set(rows["mixing"]) <= set(rows["decontamination"]) and kept["mixing"].count() > 0.6 * len(rows["decontamination"])
    assert neardup.near_duplicates(kept["near_duplicates"], Scratch(spark)).where("not kept").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == kept["mixing"].count()


def test_stages_on_awkward_documents(spark):
    """Nulls, empty and long texts, repeated ids, clashing columns, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    docs = cases.documents(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns), name
        rows, before = out.collect(), {(r.doc_id, r.text) for r in docs.collect()}
        if name == "lines":
            assert len(rows) == n and {r.doc_id for r in rows} == {i for i, _ in before}
        else:
            assert {(r.doc_id, r.text) for r in rows} <= before
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 2
        if name == "decontamination":
            assert len(rows) == n
        assert stage(spark, cases.empty(docs), sf).count() == 0, name
