"""Files of CoNLL-U text that keep arriving: appended to a corpus, and counted as they come.

Contingency tables add up over sentences, so a batch is counted by itself and totals are sums over batches. A batch writes under
its number and overwrites what an earlier attempt left, so a retried batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dependra.operators.counting import contingency_of, merge
from dependra.operators.graphs import admitted
from dependra.plans.pattern import Association
from dependra.sources.corpus import Corpus
from dependra.sources.formats import conllu_corpus, paragraphs, parse_conllu, with_places


def ingest_conllu(spark: SparkSession, source: str, target: str, checkpoint: str, queries: dict[str, Association] | None = None, sensible: bool = True, once: bool = True) -> StreamingQuery:
    """Reads new files of source; writes target/tokens, target/dependencies and target/counts, by batch."""
    lines = with_places(spark.readStream.schema("value string").text(source))

    def batch(rows: DataFrame, number: int) -> None:
        # Numbers of batches and files lie above the places in a file.
        rows = paragraphs(rows).select((F.lit(number) * F.lit(1 << 52) + F.col("ord")).alias("ord"), "value").persist()
        corpus = conllu_corpus(parse_conllu(rows))
        corpus = (admitted(corpus) if sensible else corpus).persist()
        for name, t in (("tokens", corpus.tokens), ("dependencies", corpus.dependencies)):
            t.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        for name, q in (queries or {}).items():
            contingency_of(corpus, q).withColumn("query", F.lit(name)).write.mode("overwrite").parquet(f"{target}/counts/batch={number}/part={name}")
        for t in (rows, corpus.tokens, corpus.dependencies):
            t.unpersist()

    w = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def ingested(spark: SparkSession, target: str) -> Corpus:
    return Corpus(*(spark.read.parquet(f"{target}/{x}").drop("batch") for x in ("tokens", "dependencies")))


def running_totals(spark: SparkSession, target: str, query: str) -> DataFrame:
    """(method, o11, r1, c1, n, inconsistent) over all batches so far."""
    rows = spark.read.parquet(f"{target}/counts").where(F.col("query") == query)
    return merge(rows.select("method", "o11", "r1", "c1", "n", "inconsistent"))
