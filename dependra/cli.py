"""Command-line tools: python -m dependra.cli TOOL ..."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.operators import collexemes, counting, structures
from dependra.operators.graphs import admitted
from dependra.plans.pattern import read_queries, split_association
from dependra.sources import formats
from dependra.sources.corpus import Corpus


def open_corpus(spark: SparkSession, path: str, kind: str) -> Corpus:
    if kind == "db":
        return Corpus.read(spark, path)
    made = formats.conllu_corpus(formats.read_conllu(spark, path)) if kind == "conllu" else formats.cwb_corpus(formats.read_cwb(spark, path))
    return admitted(made.persist())


def numbered(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(i + 1).alias("query_number"), "*") for i, p in enumerate(parts)])


def association_strength(spark, a) -> None:
    corpus = open_corpus(spark, a.corpus, a.format).persist()
    rows = numbered([counting.association(corpus, split_association(q)) for q in read_queries(a.queries)])
    formats.write_tsv(collexemes.wide(rows, ["query_number"]).orderBy("query_number"), a.output)


def collexeme_analysis(spark, a) -> None:
    corpus = Corpus.read(spark, a.corpus).persist()
    rows = numbered([collexemes.collexemes(corpus, q, a.collexeme) for q in read_queries(a.queries)])
    formats.write_tsv(rows.orderBy("query_number", F.desc_nulls_last("log_likelihood"), F.desc(a.collexeme)), a.output)


def covarying_collexemes(spark, a) -> None:
    corpus = Corpus.read(spark, a.corpus).persist()
    rows = numbered([collexemes.covarying(corpus, q, a.collexeme) for q in read_queries(a.queries)])
    rows = collexemes.wide(rows, ["query_number", "item_a", "item_b"]).withColumnsRenamed({"item_a": f"{a.collexeme}_A", "item_b": f"{a.collexeme}_B"})
    formats.write_tsv(rows.orderBy("query_number", F.desc_nulls_last("focus_points_log_likelihood"), F.desc(f"{a.collexeme}_A"), F.desc(f"{a.collexeme}_B")), a.output)


def associated_structures(spark, a) -> None:
    corpus = Corpus.read(spark, a.corpus).persist()
    rows = numbered([structures.larger_structures(corpus, q, a.max_size, a.min_coocc, a.lemma) for q in read_queries(a.queries)])
    rows = collexemes.wide(rows, ["query_number", "larger_structure"])
    formats.write_tsv(rows.orderBy("query_number", F.desc_nulls_last("focus_points_log_likelihood"), F.desc("larger_structure")), a.output)


def convert(spark, a) -> None:
    rows = (formats.read_conllu if a.format == "conllu" else formats.read_cwb)(spark, a.corpus).persist()
    if a.max_sentences or a.max_tokens:
        rows = formats.capped(rows.withColumn("size", F.size("rows")), "ord", a.max_sentences, a.max_tokens).drop("size")
    if a.no_id:
        rows = formats.generated_ids(rows.drop("original_id"), "ord")
    corpus = admitted((formats.conllu_corpus if a.format == "conllu" else formats.cwb_corpus)(rows).persist())
    corpus.write(a.db)
    rows.selectExpr("ord sentence_id", "original_id").join(corpus.sizes(), "sentence_id").write.parquet(f"{a.db}/sentences")


def draw(spark, a) -> None:
    formats.to_dot(Corpus.read(spark, a.corpus)).select("value").write.text(a.output)


def corenlp_json(spark, a) -> None:
    formats.write_corenlp_conllu(formats.read_corenlp_json(spark, a.json), a.output)


def corenlp_xml(spark, a) -> None:
    """CWB text: a line of seven columns for each token."""
    body = F.expr("array_join(transform(rows, r -> array_join(r, '\t')), '\n')")
    head = F.concat(F.lit('<s id="'), "original_id", F.lit('" len="'), F.size("rows"), F.lit('">\n'))
    formats.read_corenlp_xml(spark, a.xml).select(F.concat(head, body, F.lit("\n</s>")).alias("value")).write.text(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    tools = top.add_subparsers(required=True)

    def tool(name, f, *positional):
        p = tools.add_parser(name)
        p.set_defaults(run=f)
        for x in positional:
            p.add_argument(x)
        return p

    p = tool("association_strength", association_strength, "corpus", "queries")
    p.add_argument("-f", "--format", choices=("conllu", "cwb", "db"), required=True)
    p.add_argument("-o", "--output", required=True)
    for name, f in (("collexeme_analysis", collexeme_analysis), ("covarying_collexemes", covarying_collexemes)):
        p = tool(name, f, "corpus", "queries")
        p.add_argument("-c", "--collexeme", choices=("word", "lemma"), default="lemma")
        p.add_argument("-o", "--output", required=True)
    p = tool("associated_structures", associated_structures, "corpus", "queries")
    p.add_argument("--max-size", type=int, default=7)
    p.add_argument("--min-coocc", type=int, default=5)
    p.add_argument("-l", "--lemma", action="store_true")
    p.add_argument("-o", "--output", required=True)
    p = tool("convert", convert, "corpus")
    p.add_argument("--db", required=True)
    p.add_argument("-f", "--format", choices=("conllu", "cwb"), required=True)
    p.add_argument("--no-id", action="store_true")
    p.add_argument("--max-sentences", type=int, default=0)
    p.add_argument("--max-tokens", type=int, default=0)
    p = tool("draw", draw, "corpus")
    p.add_argument("-o", "--output", required=True)
    for name, f, kind in (("corenlp_json", corenlp_json, "json"), ("corenlp_xml", corenlp_xml, "xml")):
        p = tool(name, f, kind)
        p.add_argument("-o", "--output", required=True)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("dependra").getOrCreate(), a)


if __name__ == "__main__":
    main()
