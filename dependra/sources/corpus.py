"""The canonical corpus: token rows and dependency rows, both keyed by sentence_id."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets joins on sentence_id and more use a dealing by sentence_id alone; else Spark would shuffle both sides again.
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

#: Off while the plan of a cached corpus is made: an adaptive plan hides its partitioning from later joins.
ADAPTIVE = "spark.sql.adaptive.enabled"

TOKENS = "sentence_id long, position int, word string, pos string, lemma string, wc string, indegree int, outdegree int, root boolean"
DEPENDENCIES = "sentence_id long, governor int, dependent int, relation string"


@dataclasses.dataclass(frozen=True)
class Corpus:
    tokens: DataFrame
    dependencies: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.tokens.sparkSession

    def only(self, sentences: DataFrame) -> Corpus:
        """The part whose sentence_id is in sentences."""
        return Corpus(*(t.join(sentences.select("sentence_id"), "sentence_id", "left_semi") for t in (self.tokens, self.dependencies)))

    def sizes(self) -> DataFrame:
        """(sentence_id, n_tokens, n_deps)."""
        t = self.tokens.groupBy("sentence_id").agg(F.count("*").alias("n_tokens"))
        return t.join(self.dependencies.groupBy("sentence_id").agg(F.count("*").alias("n_deps")), "sentence_id", "left").fillna(0, ["n_deps"])

    def graphs(self) -> DataFrame:
        """One row a sentence: sentence_id, tokens (by position), dependencies (by governor, dependent)."""
        t = self.tokens.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("position", "word", "pos", "lemma", "wc", "root"))).alias("tokens"))
        d = self.dependencies.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("governor", "dependent", "relation"))).alias("dependencies"))
        empty = F.array().cast(d.schema["dependencies"].dataType)
        return t.join(d, "sentence_id", "left").withColumn("dependencies", F.coalesce("dependencies", empty))

    def persist(self, partitions: int | None = None) -> Corpus:
        """Kept, dealt by sentence_id: joins on sentence_id and more need no further shuffle."""
        self.spark.conf.set(SUBSET_KEYS, "false")
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        before = self.spark.conf.get(ADAPTIVE)
        self.spark.conf.set(ADAPTIVE, "false")
        try:
            return Corpus(*(t.repartition(n, "sentence_id").persist() for t in (self.tokens, self.dependencies)))
        finally:
            self.spark.conf.set(ADAPTIVE, before)

    def save(self, name: str, buckets: int = 200, path: str | None = None) -> None:
        """Tables name_tokens and name_dependencies, bucketed and sorted by sentence_id."""
        for kind, t, order in (("tokens", self.tokens, ["sentence_id", "position"]), ("dependencies", self.dependencies, ["sentence_id", "governor", "dependent"])):
            w = t.write.mode("overwrite").bucketBy(buckets, "sentence_id").sortBy(*order)
            (w.option("path", f"{path}/{kind}") if path else w).saveAsTable(f"{name}_{kind}")

    @staticmethod
    def load(spark: SparkSession, name: str) -> Corpus:
        spark.conf.set(SUBSET_KEYS, "false")
        return Corpus(spark.table(f"{name}_tokens"), spark.table(f"{name}_dependencies"))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.tokens.write.mode(mode).parquet(f"{path}/tokens")
        self.dependencies.write.mode(mode).parquet(f"{path}/dependencies")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Corpus:
        return Corpus(spark.read.schema(TOKENS).parquet(f"{path}/tokens"), spark.read.schema(DEPENDENCIES).parquet(f"{path}/dependencies"))


def with_degrees(tokens: DataFrame, dependencies: DataFrame) -> DataFrame:
    """tokens (sentence_id, position, ...) with indegree and outdegree: one aggregation of both ends of every edge."""
    ends = dependencies.selectExpr("sentence_id", "inline(array(named_struct('position', governor, 'o', 1, 'i', 0), named_struct('position', dependent, 'o', 0, 'i', 1)))")
    ends = ends.groupBy("sentence_id", "position").agg(F.sum("i").cast("int").alias("indegree"), F.sum("o").cast("int").alias("outdegree"))
    return tokens.join(ends, ["sentence_id", "position"], "left").fillna(0, ["indegree", "outdegree"])


def build(tokens: DataFrame, dependencies: DataFrame) -> Corpus:
    """From tokens (sentence_id, position, word, pos, lemma, wc, root) and dependencies: unconnected tokens that aren't roots go,
    positions become consecutive, degrees are added. Both are dealt by sentence once, which all joins and windows here share."""
    spark = tokens.sparkSession
    spark.conf.set(SUBSET_KEYS, "false")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens, dependencies = tokens.repartition(n, "sentence_id"), dependencies.repartition(n, "sentence_id")
    ends = dependencies.select("sentence_id", F.explode(F.array("governor", "dependent")).alias("position")).distinct().withColumn("linked", F.lit(True))
    kept = tokens.join(ends, ["sentence_id", "position"], "left").where("root or linked").drop("linked")
    kept = kept.withColumn("at", F.expr("cast(row_number() over (partition by sentence_id order by position) - 1 as int)"))
    at = kept.select("sentence_id", "position", "at")
    deps = dependencies.join(at.withColumnsRenamed({"position": "governor", "at": "g"}), ["sentence_id", "governor"]).join(at.withColumnsRenamed({"position": "dependent", "at": "d"}), ["sentence_id", "dependent"])
    deps = deps.selectExpr("sentence_id", "g governor", "d dependent", "relation")
    names = [f.split()[0] for f in TOKENS.split(", ")]
    return Corpus(with_degrees(kept.drop("position").withColumnRenamed("at", "position"), deps).select(*names), deps)
