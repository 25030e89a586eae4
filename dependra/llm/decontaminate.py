"""Benchmark decontamination: every passage of the training text queries a BM25 index of the test items.

Items are indexed in units of at most unit_words words. A training text is cut into passages of three strides (so that any unit
lies whole in some passage). A unit's BM25 impacts are divided by its score for itself: a passage that holds the
unit scores 1, and all units above `threshold` are retrieved. Units are sorted by length and lie in blocks; a term's postings are its
blocks in order, each with the block's largest impact, and with the largest impact from there on. All passages of a slice of text go through
block-max WAND side by side: of a passage's terms, sorted by the block that their cursors stand at, the first with which the
impacts still to come reach the threshold names the pivot block; the cursors before it skip to it; only if the block's own
largest impacts reach the threshold too are its units scored. Nothing above the threshold is missed. A retrieved item counts as leaked if
`similarity` of the 5-word shingles of its question and as much of those of its answer occur in the document. Benchmarks with
one text have its first two thirds as the question, the rest as the answer.

An item that is scattered over a document, so that no passage holds `threshold` of the weight of one of its units, isn't retrieved and not
reported, however much of it the document has in all.

The index is cut into shards of a bounded number of words, built and sent to the executors one after the other, so a larger benchmark
means more passes, not a larger index; document frequencies are those of the whole benchmark.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts, and texts or items without a word,
match nothing; a part with fewer than 5 words is one shingle. Repeated items are each reported, items with a null id by it; rows with one doc_id are
reported as one document, by their best passage. Other columns are ignored, or pass through in the filter.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, slices, table, with_python

WORD = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(words: list[str], size: int = 5) -> set[tuple]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


class BlockMaxIndex:
    """Postings of one shard; rows are (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int], n_items: int, mean_words: float, unit_words: int = 64, block: int = 16, stride: int = 32, threshold: float = 0.6, k1: float = 1.2, b: float = 0.75):
        self.items, self.stride, self.threshold, self.block = items, stride, threshold, block
        units = []
        for at, (_, ws) in enumerate(items):
            n = -(-len(ws) // unit_words)
            units += [(at, ws[i * len(ws) // n : (i + 1) * len(ws) // n]) for i in range(n)]
        units.sort(key=lambda u: (len(u[1]), u[1], u[0]))  # like units share blocks, which keeps the bounds tight
        self.terms: dict[str, int] = {}
        self.units: list[tuple[int, dict[int, float]]] = []
        for at, ws in units:
            tf: dict[str, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            raw = {w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(ws) / mean_words)) for w, n in tf.items()}
            own = sum(raw.values())
            self.units.append((at, {self.terms.setdefault(w, len(self.terms)): v / own for w, v in raw.items()}))
        self.n_blocks = -(-len(self.units) // block)
        posts = sorted((t, i, v) for i, (_, impacts) in enumerate(self.units) for t, v in impacts.items())
        term, self.post_unit = (np.array([p[k] for p in posts], np.int64) for k in (0, 1))
        self.post_impact = np.array([p[2] for p in posts], float)
        # Block postings: key (term, block), where their units' postings begin, the largest impact, and the largest from here on.
        self.key, self.first = np.unique(term * self.n_blocks + self.post_unit // block, return_index=True) if posts else (np.zeros(0, np.int64),) * 2
        self.first = np.append(self.first, len(posts))
        self.most = np.maximum.reduceat(self.post_impact, self.first[:-1]) if posts else np.zeros(0)
        self.begin = np.searchsorted(self.key, np.arange(len(self.terms)) * self.n_blocks)
        self.ahead = self.most.copy()
        for c in range(len(self.key) - 2, -1, -1):
            if self.key[c] // self.n_blocks == self.key[c + 1] // self.n_blocks:
                self.ahead[c] = max(self.ahead[c], self.ahead[c + 1])

    def search(self, texts: list[list[str]]) -> list[tuple[int, int, int, float]]:
        """(text, item, first word of the passage, score): each retrieved item's best passage."""
        s, n_terms, n_blocks = self.stride, max(1, len(self.terms)), self.n_blocks
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        n_strides = -(-sizes // s)
        first = np.concatenate([[0], np.cumsum(n_strides)])
        if not self.units or not first[-1]:
            return []
        term = np.fromiter(map(self.terms.get, chain.from_iterable(texts), repeat(-1)), np.int64, sizes.sum())
        place = np.flatnonzero(term >= 0)
        term = term[place]
        text = np.repeat(np.arange(len(texts)), sizes)[place]
        own = first[text] + (place - (np.cumsum(sizes) - sizes)[text]) // s
        begins = first[text]  # the first stride of a stride's text
        keys = np.sort(np.concatenate([own * n_terms + term] + [((own - k) * n_terms + term)[own - k >= begins] for k in (1, 2)]))
        passage, term = np.divmod(keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]], n_terms)
        at = self.begin[term]  # cursors, at each term's first block
        least, hits = self.threshold - 1e-9, []
        while len(at):
            block = self.key[at] - term * n_blocks
            order = np.argsort(passage * n_blocks + block, kind="stable")
            passage, term, at, block = passage[order], term[order], at[order], block[order]
            new = np.concatenate([[True], passage[1:] != passage[:-1]])
            total = np.cumsum(self.ahead[at])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            reached = total - (total[start] - self.ahead[at[start]])[run] >= least
            pivot = np.full(len(start), -1)
            firsts = np.flatnonzero(reached & np.concatenate([[True], ~reached[:-1] | new[1:]]))
            pivot[run[firsts]] = block[firsts]
            # Passages without a pivot are done; cursors before it skip to the first block that isn't.
            goes = pivot[run] >= 0
            passage, term, at, aim, run = passage[goes], term[goes], at[goes], pivot[run][goes], run[goes]
            late = np.flatnonzero(block[goes] < aim)
            at[late] = np.searchsorted(self.key, term[late] * n_blocks + aim[late])
            there = np.zeros(len(at), bool)
            inside = at < len(self.key)
            there[inside] = self.key[at[inside]] == (term * n_blocks + aim)[inside]
            bound = np.bincount(run[there], self.most[at[there]], len(start))
            take = there & (bound[run] >= least)
            if take.any():
                hits.append((passage[take] * n_blocks + aim[take], at[take]))
            at = at + there
            inside = at < len(self.key)
            inside[inside] = self.key[at[inside]] // n_blocks == term[inside]
            passage, term, at = passage[inside], term[inside], at[inside]
        if not hits:
            return []
        # The units of the blocks that are left, all at once.
        where, at = (np.concatenate(x) for x in zip(*hits))
        where, which = np.unique(where, return_inverse=True)
        count = self.first[at + 1] - self.first[at]
        posts = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        scores = np.bincount(np.repeat(which, count) * self.block + self.post_unit[posts] % self.block, self.post_impact[posts], len(where) * self.block)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for h in np.flatnonzero(scores >= self.threshold).tolist():
            passed, blk = divmod(int(where[h // self.block]), n_blocks)
            item = self.units[blk * self.block + h % self.block][0]
            t = int(np.searchsorted(first, passed, side="right")) - 1
            best = (float(scores[h]), -(passed - int(first[t])) * s)
            found[t, item] = max(found.get((t, item), best), best)
        return [(t, item, -begin, score) for (t, item), (score, begin) in found.items()]

    def leaks(self, texts: list[str | None], similarity: float = 0.8) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item_id, passage, score, question overlap, answer overlap) of what search() retrieves and overlap confirms."""
        out, words = [], [item_words(t) for t in texts]
        held: tuple[int, set] = (-1, set())
        for t, item, begin, score in sorted(self.search(words)):
            item_id, ws = self.items[item]
            cut = len(ws) - len(ws) // 3
            parts = []
            for part in (ws[:cut], ws[cut:] or ws[:cut]):
                want = grams(part)
                size = min(5, len(part))
                if held[0] != (t, size):
                    held = ((t, size), {tuple(words[t][i : i + size]) for i in range(len(words[t]) - size + 1)})
                parts.append(len(want & held[1]) / len(want))
            if min(parts) >= similarity:
                out.append((t, item_id, begin, score, *parts))
        return out


def indexes(benchmark: DataFrame, shard_words: int = 200_000, **options):
    """One index after the other, for every shard_words words or so of the benchmark's items."""

    def split(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([item_words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["item_id", "ws"])

    items = benchmark.select("item_id", "text").mapInArrow(split, "item_id long, ws array<string>").where("size(ws) > 0")
    n, total = items.agg(F.count("*"), F.sum(F.size("ws"))).first()
    shards = -(-(total or 0) // shard_words)
    shard = F.expr(f"pmod(xxhash64(item_id, ws), {shards})")
    df = items.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = items.where(shard == k)
        used = own.select(F.explode("ws").alias("w")).distinct()
        counts = {r[0]: r[1] for r in (df if shards == 1 else df.join(used, "w", "left_semi")).collect()}  # at most shard_words
        yield k == shards - 1, BlockMaxIndex(sorted(((r[0], list(r[1])) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), counts, n, total / n, **options)


_LEAK = "doc_id long, item_id long, passage int, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, similarity: float = 0.8, **options) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): an item's best passage in each document that leaks it."""
    names = [f.split()[0] for f in _LEAK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    out = None
    for n, (last, index) in enumerate(indexes(benchmark, **options)):

        def run(batches, index=index):
            for part in slices(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r[0]], *r[1:]) for r in index.leaks(part.column("text").to_pylist(), similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        one = docs.select("doc_id", "text").mapInArrow(run, _LEAK)
        if n or not last:  # of several shards, each one's leaks are written before the next is built
            one = scratch.save(one, f"leaks_{n}")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], _LEAK)
    best = F.max(F.struct("score", F.col("question_overlap"), F.col("answer_overlap"), (-F.col("passage")).alias("at"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "-m.at passage", "m.score score", "m.question_overlap question_overlap", "m.answer_overlap answer_overlap")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, similarity: float = 0.8, **options) -> DataFrame:
    """docs without those that leak an item; one pass over the text for each shard, without a join."""
    columns = docs.columns
    for n, (last, index) in enumerate(indexes(benchmark, **options)):

        def make(index=index):
            def fn(batch):
                leaked = {r[0] for r in index.leaks(batch.column("text").to_pylist(), similarity)}
                return [[i in leaked for i in range(batch.num_rows)]]

            return fn

        docs = with_python(docs, make, "leaked__ boolean").where("not leaked__").select(*columns)
        if not last:
            docs = scratch.save(docs, f"clean_{n}")
            scratch.drop(f"clean_{n - 1}")
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
    return found.select("doc_id", "item_id", "question_overlap", "answer_overlap")


#: Without retrieval: all overlaps of all items with all documents.
OP5_SQL = """
with i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') ws from benchmark),
q as (select item_id, p, case when p = 0 or len(ws) < 3 then ws[1:len(ws) - len(ws) // 3] else ws[len(ws) - len(ws) // 3 + 1:] end ws from i, (select unnest([0, 1]) p) where len(ws) > 0),
g as materialized (select item_id, p, least(5, len(ws)) k, list_distinct(list_transform(range(0, len(ws) - least(5, len(ws)) + 1), lambda j: array_to_string(ws[j + 1:j + least(5, len(ws))], ' '))) gs from q),
need as (select item_id, p, k, unnest(gs) x from g),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') ws from documents),
have as materialized (select distinct doc_id, k, array_to_string(ws[j + 1:j + k], ' ') x from (select doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) j from d, (select distinct k from g)) where (k, array_to_string(ws[j + 1:j + k], ' ')) in (select (k, x) from need)),
o as (select doc_id, g.item_id, g.p, count(*) / any_value(len(gs)) overlap from have join need on have.k = need.k and have.x = need.x join g on g.item_id = need.item_id and g.p = need.p group by all)
select a.doc_id, a.item_id, a.overlap question_overlap, b.overlap answer_overlap from o a join o b on a.doc_id = b.doc_id and a.item_id = b.item_id and a.p = 0 and b.p = 1 where a.overlap >= 0.8 and b.overlap >= 0.8
"""


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts leak nothing, of repeated rows all go."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))
