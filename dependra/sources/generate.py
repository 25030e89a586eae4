"""Seeded random treebanks and queries."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.plans.pattern import Pattern
from dependra.sources.corpus import Corpus, with_degrees


def _u(salt: int, *keys: str) -> str:
    """A uniform number made from a hash: the same for the same keys, whatever the partitioning."""
    return f"(pmod(xxhash64({salt}, {', '.join(keys)}), 1000000007) / 1000000007D)"


def _pick(size: int, distribution: str, u: str, prefix: str, underspecified: float, v: str) -> str:
    """A label of a vocabulary of `size`: uniform, or with chances that fall as 1 / rank (zipf)."""
    rank = f"floor({u} * {size})" if distribution == "uniform" else f"least({size - 1}, floor(pow({size + 1}D, {u})) - 1)"
    return f"if({v} < {underspecified}D, '.+', format_string('{prefix}%05d', cast({rank} as int)))"


def lengths(sentences: DataFrame, distribution: str = "uniform", low: int = 3, high: int = 12, mean: float = 7, sd: float = 2, seed: int = 0) -> DataFrame:
    """sentences (sentence_id) with length; normal lengths are drawn again until they fit, by the first fitting of 64 draws."""
    if distribution == "uniform":
        return sentences.withColumn("length", F.expr(f"cast({low} + floor({_u(seed, 'sentence_id')} * {high - low + 1}) as int)"))
    gauss = f"cast(round({mean} + {sd} * sqrt(-2 * ln(greatest({_u(seed, 'sentence_id', 'i')}, 1e-9D))) * cos(2 * pi() * {_u(seed + 1, 'sentence_id', 'i')})) as int)"
    drawn = f"filter(transform(sequence(0, 63), i -> {gauss}), x -> x between {low} and {high})"
    return sentences.withColumn("length", F.expr(f"coalesce(try_element_at({drawn}, 1), {low})"))


def random_treebank(spark: SparkSession, n: int, vocabulary: int = 100, relations: int = 8, labels: str = "zipf", degrees: str = "uniform", max_outdegree: int = 10, underspecified: float = 0.0, root: bool = True, seed: int = 0, **length) -> Corpus:
    """n random labelled rooted trees. A token hangs from an earlier one: any (degrees uniform), or rather the first ones
    (zipf, powerlaw). Where that one has max_outdegree dependents already, the next one that has fewer takes it."""
    s = lengths(spark.range(n).withColumnRenamed("id", "sentence_id"), seed=seed, **length)
    t = s.select("sentence_id", F.explode(F.expr("sequence(0, length - 1)")).alias("position"))
    word = _pick(vocabulary, labels, _u(seed + 2, "sentence_id", "position"), "w", underspecified, _u(seed + 3, "sentence_id", "position"))
    tokens = t.selectExpr("sentence_id", "position", f"{word} word", f"format_string('p%d', cast(floor({_u(seed + 4, 'sentence_id', 'position')} * 5) as int)) pos")
    tokens = tokens.selectExpr("sentence_id", "position", "word", "pos", "word lemma", "upper(pos) wc", f"position = 0 and {str(root).lower()} root")
    power = {"uniform": 1, "zipf": 2, "powerlaw": 3}[degrees]
    aim = f"cast(floor(p * pow({_u(seed + 5, 'sentence_id', 'p')}, {power})) as int)"
    free = f"array_min(transform(filter(sequence(0, p - 1), i -> a.used[i] < {max_outdegree}), i -> named_struct('far', (i - {aim} + p) % p, 'i', i))).i"
    step = f"transform(array({free}), g -> named_struct('used', transform(a.used, (x, i) -> if(i = g, x + 1, x)), 'g', array_append(a.g, g)))[0]"
    start = "named_struct('used', array_repeat(0, length), 'g', cast(array() as array<int>))"
    fold = f"aggregate(if(length > 1, sequence(1, length - 1), cast(array() as array<int>)), {start}, (a, p) -> {step}, a -> a.g)"
    t = s.select("sentence_id", F.posexplode(F.expr(fold)).alias("at", "governor")).selectExpr("sentence_id", "governor", "at + 1 position")
    deps = t.selectExpr("sentence_id", "governor", "position dependent", f"{_pick(relations, labels, _u(seed + 6, 'sentence_id', 'position'), 'r', underspecified, _u(seed + 7, 'sentence_id', 'position'))} relation")
    return Corpus(with_degrees(tokens, deps).select("sentence_id", "position", "word", "pos", "lemma", "wc", "indegree", "outdegree", "root"), deps)


def near_treebank(trees: Corpus, share: float = 0.1, relation: str = "extra", seed: int = 0) -> Corpus:
    """Trees with further edges: a token gets one with the chance `share`, from a token before it that isn't its governor or dependent yet."""
    u, v = _u(seed, "sentence_id", "position"), _u(seed + 1, "sentence_id", "position")
    some = trees.tokens.where(f"position > 0 and {u} < {share}D").selectExpr("sentence_id", f"cast(floor({v} * position) as int) governor", "position dependent", f"'{relation}' relation")
    taken = trees.dependencies.select("sentence_id", F.least("governor", "dependent").alias("governor"), F.greatest("governor", "dependent").alias("dependent"))
    deps = trees.dependencies.unionByName(some.join(taken, ["sentence_id", "governor", "dependent"], "left_anti").select(*trees.dependencies.columns))
    tokens = with_degrees(trees.tokens.drop("indegree", "outdegree"), deps)
    return Corpus(tokens.select(*trees.tokens.columns), deps)


def split_tree(tree: Pattern, seed: int = 0) -> tuple[Pattern, Pattern, Pattern, Pattern, Pattern]:
    """A tree cut at a random edge: A, B, and over the whole tree R1 (A's labels), C1 (B's) and N (none)."""
    rng = random.Random(seed)
    s, t, e = rng.choice(tree.edges)
    below = {t}
    while more := {y for x, y, _ in tree.edges if x in below} - below:
        below |= more
    above = set(range(len(tree))) - below
    end = rng.random() < 0.5
    keep_a, keep_b = above | ({t} if end else set()), below | (set() if end else {s})

    def part(keep: set[int], own: set[int]) -> Pattern:
        p = tree.subpattern(keep)
        return Pattern(tuple(dict(v) if p.vids[i] in own else {"word": ".+"} for i, v in enumerate(p.vertices)), p.edges, p.name, p.vids)

    def whole(own: set[int]) -> Pattern:
        edges = tuple((x, y, dict(d) if {x, y} <= own else {"relation": ".+"}) for x, y, d in tree.edges)
        return Pattern(tuple(v | {"word": v.get("word", ".+") if i in own else ".+"} for i, v in enumerate(tree.vertices)), edges, tree.name)

    return part(keep_a, above), part(keep_b, below), whole(keep_a), whole(keep_b), whole(set())
