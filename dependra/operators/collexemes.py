"""Simple and covarying collexeme analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dependra.functions.measures import with_measures
from dependra.operators.counting import METHODS, by_unit
from dependra.plans.compiler import columns, embeddings, vertex_tests
from dependra.plans.pattern import Pattern
from dependra.sources.corpus import Corpus


def _items(corpus: Corpus, position: str, kind: str, name: str) -> DataFrame:
    return corpus.tokens.select("sentence_id", F.col("position").alias(position), F.col(kind).alias(name))


def collexemes(corpus: Corpus, query: Pattern, kind: str = "lemma", digits: int | None = None) -> DataFrame:
    """Items in the slot marked collo_item: kind, o11, r1, c1, n and measures.

    Slots are counted once each. c1 and n count tokens with the slot's labels alone, without its relations.
    """
    slot = query.marked("collo_item")
    if len(slot) != 1:
        raise ValueError("one vertex needs the mark collo_item")
    plain = query.without("collo_item")
    at = f"m{slot[0]}"
    hits = embeddings(corpus, plain).select("sentence_id", at).distinct()
    o11 = hits.join(_items(corpus, at, kind, kind), ["sentence_id", at]).groupBy(kind).agg(F.count("*").alias("o11"))
    all_slots = reduce(lambda df, t: df.where(t), vertex_tests(plain.vertices[slot[0]]), corpus.tokens)
    c1 = all_slots.groupBy(kind).agg(F.count("*").alias("c1"))
    totals = o11.agg(F.sum("o11").alias("r1")).crossJoin(all_slots.agg(F.count("*").alias("n")))  # one row
    rows = o11.join(c1, kind).crossJoin(F.broadcast(totals)).select(kind, "o11", "r1", "c1", "n")
    return with_measures(rows, digits=digits)


def ranked(rows: DataFrame, by: str, *items: str) -> DataFrame:
    """In falling order of a measure, then of the items."""
    return rows.orderBy(F.desc_nulls_last(by), *[F.desc(x) for x in items])


def top(rows: DataFrame, k: int, by: str, *items: str) -> DataFrame:
    return ranked(rows, by, *items).limit(k)


def covarying(corpus: Corpus, query: Pattern, kind: str = "lemma", digits: int | None = None) -> DataFrame:
    """Pairs of items in the slots marked collo_A and collo_B: item_a, item_b, method, o11, r1, c1, n, inconsistent, measures.

    A pair of items that both occur in a unit, but never together in it, makes the unit inconsistent for the pair (embeddings
    hold one pair each). Marginals add up a pair's counts over its partners.
    """
    a, b = query.marked("collo_A"), query.marked("collo_B")
    if len(a) != 1 or len(b) != 1:
        raise ValueError("one vertex needs the mark collo_A, one collo_B")
    marked = query.marked("focus_point")
    plain = query.without("collo_A", "collo_B", "focus_point")
    focus = marked[0] if marked else plain.focus_point()
    ma, mb = f"m{a[0]}", f"m{b[0]}"
    found = embeddings(corpus, plain).join(_items(corpus, ma, kind, "item_a"), ["sentence_id", ma]).join(_items(corpus, mb, kind, "item_b"), ["sentence_id", mb])
    units = by_unit(found, columns(plain), f"m{focus}", "item_a", "item_b")
    # A pair's embeddings are counted as they are, the other units once.
    pairs = units.groupBy("method", "sentence_id", "unit", "item_a", "item_b").agg(F.count("*").alias("k"))
    counts = pairs.groupBy("method", "item_a", "item_b").agg(F.expr("sum(if(method = 'embeddings', k, 1))").alias("o11"))
    size = units.select("method", "sentence_id", "unit").distinct().groupBy("method").agg(F.count("*").alias("n"))
    lacking = _lacking(pairs)
    rows = counts.join(lacking, ["method", "item_a", "item_b"], "left").fillna(0, ["inconsistent"])
    rows = rows.withColumn("ra", F.sum("o11").over(Window.partitionBy("method", "item_a"))).withColumn("cb", F.sum("o11").over(Window.partitionBy("method", "item_b")))
    rows = rows.join(F.broadcast(size), "method")  # four rows
    half = F.col("inconsistent").cast("double") / 2
    rows = rows.select("item_a", "item_b", "method", "o11", (F.col("ra") - half).alias("r1"), (F.col("cb") - half).alias("c1"), "n", "inconsistent")
    return with_measures(rows, digits=digits)


def _lacking(pairs: DataFrame) -> DataFrame:
    """(method, item_a, item_b, inconsistent): units with both items but not the pair, by a join within units."""
    unit = ["method", "sentence_id", "unit"]
    some = pairs.where("method <> 'embeddings'")
    left, right = some.select(*unit, "item_a").distinct(), some.select(*unit, "item_b").distinct()
    both = left.join(right, unit).join(some.select(*unit, "item_a", "item_b"), [*unit, "item_a", "item_b"], "left_anti")
    return both.groupBy("method", "item_a", "item_b").agg(F.count("*").alias("inconsistent"))


def wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of keys, with the columns of every counting method side by side."""
    names = ["o11", "r1", "c1", "n", "inconsistent", "log_likelihood", "t_score", "dice"]
    out = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in names])
    return out
