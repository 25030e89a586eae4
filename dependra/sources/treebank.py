"""A treebank derived from the order tables: a sentence is an order, a token one of its line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.sources.corpus import Corpus, build, with_degrees

#: The corpora of this session in the order of their use; beyond MOST, the one not used for longest is let go.
_KEPT: dict[tuple, Corpus] = {}
MOST = 4


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    # Joined before the window, whose dealing by sentence then lasts for all that follows.
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
    rows = line.join(part, F.expr("l_partkey = p_partkey")).withColumn("sentence_id", F.col("l_orderkey").cast("long"))
    return rows.withColumn("position", F.expr(f"cast(row_number() over (partition by sentence_id order by {order}) - 1 as int)"))


def derive(rows: DataFrame, raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Token rows without degrees, and dependency rows; raw: without the edges to highly taxed items."""
    tokens = rows.selectExpr(
        "sentence_id", "position", "concat(p_name, '/', l_linestatus) word", "l_linestatus pos", "p_name lemma",
        "case l_returnflag when 'R' then 'VERB' when 'A' then 'NOUN' when 'N' then 'ADJ' end wc", "position = 0 root")
    edges = """concat(
        array(named_struct('governor', (position - 1) div 2, 'relation', element_at(array('obj', 'iobj', 'obl', 'det', 'nmod', 'amod'), cast(p_size % 6 + 1 as int)))),
        if(position >= 5 and position % 2 = 1 and l_quantity >= 40, array(named_struct('governor', cast(position - 2 as long), 'relation', 'conj')), array()))"""
    kept = rows.where("position > 0" + (" and l_tax < 0.08" if raw else ""))
    deps = kept.selectExpr("sentence_id", "position dependent", f"inline({edges})")
    return tokens, deps.selectExpr("sentence_id", "cast(governor as int) governor", "dependent", "relation")


def treebank(spark: SparkSession, sf_dir: str, raw: bool = False) -> Corpus:
    """The derived corpus, kept in the session (dealt by sentence); raw: with unconnected tokens and no admission yet."""
    key = (spark.sparkContext.applicationId, sf_dir, raw)
    if key not in _KEPT:
        tokens, deps = derive(items(spark, sf_dir), raw)
        if raw:
            made = build(tokens, deps)
        else:
            names = ["sentence_id", "position", "word", "pos", "lemma", "wc", "indegree", "outdegree", "root"]
            made = Corpus(with_degrees(tokens, deps).select(*names), deps)
        _KEPT[key] = made.persist()
    _KEPT[key] = _KEPT.pop(key)
    while len(_KEPT) > MOST:
        old = _KEPT.pop(next(iter(_KEPT)))
        for t in (old.tokens, old.dependencies):
            t.unpersist()
    return _KEPT[key]
