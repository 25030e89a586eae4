"""Mixing sources to target weights by Poisson replication.

A source with n documents and the target share w of `total` rows has the mean repetition rate w * total / n. Each document's
number of copies inverts the Poisson distribution of that rate at a uniform number made from a hash of seed and doc_id: no
state, the same on every run and for every partitioning. Rates over 64 are summed from equal parts of at most 64 (a sum
of independent Poisson counts is one), each with its own hash. Copies are exploded and sorted by a hash over all of them.

Defined cases: a null source is a source of its own. Null doc_ids hash as the text `null`; rows with one doc_id get equal
counts. Sources without a target weight get none, and weights of sources without rows don't count. An empty table gives no rows. Columns named copy or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import table

#: A source's row of the rate table takes some 2 KB: up to this many are broadcast, more are joined by shuffling.
BROADCAST_SOURCES = 4_000


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.7, total: int | None = None) -> DataFrame:
    """(source, parts, cdf): cdf[k] is the probability of at most k copies by one part.

    weights: (source, weight), relative; by default every source's row count to `power`, which lifts small sources.
    total: rows aimed at, by default as many as docs has.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    w = n.withColumn("weight", F.expr(f"pow(cast(n as double), {power}D)")) if weights is None else n.alias("n").join(weights.alias("w"), F.expr("n.source <=> w.source")).selectExpr("n.source source", "n", "cast(w.weight as double) weight")
    sums = n.agg(F.sum("n").alias("rows")).crossJoin(w.agg(F.sum("weight").alias("all_weight")))  # one row
    aim = "rows" if total is None else str(total)
    lam = w.crossJoin(F.broadcast(sums)).where("weight > 0").selectExpr("source", f"({aim}) * weight / all_weight / n rate")
    part = lam.selectExpr("source", "cast(ceil(rate / 64) as int) parts", "rate / ceil(rate / 64) r")
    fold = """aggregate(sequence(1, cast(ceil(r + 12 * sqrt(r) + 25) as int)),
        named_struct('p', exp(-r), 'c', exp(-r), 'a', array(exp(-r))),
        (s, k) -> named_struct('p', s.p * r / k, 'c', s.c + s.p * r / k, 'a', concat(s.a, array(s.c + s.p * r / k))),
        s -> s.a)"""
    return part.selectExpr("source", "parts", f"{fold} cdf")


def uniform(key: str) -> str:
    """52 bits of the md5 hash of a SQL string, from 0 up to 1."""
    return f"(cast(conv(substr(md5({key}), 1, 13), 16, 10) as bigint) / 4503599627370496D)"


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.7, total: int | None = None, seed: int = 17) -> DataFrame:
    """docs with copy (from 0) and mix_key, in the order of mix_key over the whole table."""
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    by = rates(docs, weights, power, total)
    small = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    by = by.withColumnRenamed("source", "source__")
    rows = docs.select(*names).join(F.broadcast(by) if small else by, F.expr("source <=> source__"))
    key = "coalesce(cast(doc_id as string), 'null')"
    count = f"aggregate(sequence(0, parts - 1), 0, (s, p) -> s + size(filter(cdf, c -> {uniform(f"concat('{seed}:', {key}, ':', p)")} >= c)))"
    rows = rows.withColumn("n__", F.expr(count)).where("n__ > 0").withColumn("copy", F.expr("explode(sequence(0, n__ - 1))"))
    return rows.withColumn("mix_key", F.expr(f"md5(concat('{seed}:mix:', {key}, ':', copy))")).select(*names, "copy", "mix_key").orderBy("mix_key", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP8_SQL = """
with n as (select source, count(*) n from documents group by source),
w as (select source, n, pow(n::double, 0.7) weight from n),
lam as (select source, (select count(*) from documents) * weight / (select sum(weight) from w) / n rate from w),
part as (select source, ceil(rate / 64)::int parts, rate / ceil(rate / 64) r from lam),
pmf as (select source, parts, k, exp(-r + k * ln(r) - lgamma(k + 1)) p from (select *, unnest(range(0, ceil(r + 12 * sqrt(r) + 26)::bigint)) k from part)),
cdf as (select source, parts, sum(p) over (partition by source order by k) c from pmf),
lists as (select source, any_value(parts) parts, list(c) cs from cdf group by source),
d as (select doc_id, documents.source, text, coalesce(doc_id::varchar, 'null') key, parts, cs from documents join lists on documents.source is not distinct from lists.source),
u as (select doc_id, source, text, key, list_sum(list_transform(range(0, parts), lambda p: len(list_filter(cs, lambda c: ('0x' || substr(md5('17:' || key || ':' || p), 1, 13))::bigint / 4503599627370496.0 >= c))))::int n from d),
e as (select doc_id, source, text, key, unnest(range(0, n))::int as copy from u where n > 0)
select doc_id, source, text, copy, md5('17:mix:' || key || ':' || copy) mix_key from e
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them, with copy and mix_key, in its order. A null source is one of its own; repeated rows are each
    counted and drawn alike."""
    return mix_sources(docs)
