"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n_docs, max_doc), bucketed and sorted by key. Each new batch of documents merge-anti-joins the
runs: its fresh keys, those in no run, become its own run, so that a key lies in one run only; what the anti-join takes away is
a repeat and goes to a log of sightings. Two runs of one level are compacted into one of the next, so that n batches leave
about log2(n) runs. A key's documents are those of its run and of the log. Runs, compaction and log need no shuffle
beyond the batch's own.

Keys in more than one of `hot` rows are so few that they are broadcast (at most hot keys can be); the other keys meet their lines by
a shuffle in which none of them is large.

A line's key is a 128-bit hash of the line, stripped of [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Lines
whose key has at least min_chars code points and is in at least min_docs documents stay only in the largest doc_id
that holds it.

Defined cases: a null or empty text is one empty line (a null text stays null in the operator's output). A text that
loses all its lines becomes empty. Rows with one doc_id count as one document; rows with a null doc_id count for nothing
and keep their lines. Other columns pass through; columns named n_lines, n_dropped are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, hot_join, slices, table, with_python

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    line = line.strip(BLANK)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


class LineRuns:
    """The levels of runs and the log of sightings; tables in the shared scratch folder, out of the catalog after close()."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.levels, self.log, self.made = scratch, buckets, {}, [], 0

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run_{self.scratch.root[-12:]}_{self.made}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name, self.scratch.spark.table(name)

    def _drop(self, name: str) -> None:
        self.scratch.spark.sql(f"drop table {name}")
        self.scratch.drop(name)

    def runs(self) -> list[DataFrame]:
        return [t for _, (_, t) in sorted(self.levels.items())]

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, key), each pair once, no doc_id of an earlier batch."""
        own = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        held = self._write(own.repartition(self.buckets, "key"))
        if self.levels:
            every, fresh = held, held[1]
            for t in self.runs():
                fresh = fresh.join(t.select("key"), "key", "left_anti")
            held = self._write(fresh)
            self.log.append(self._write(every[1].join(held[1].select("key"), "key", "left_anti")))
            self._drop(every[0])
        level = 0
        while level in self.levels:
            name, older = self.levels.pop(level)
            # No key is in both: the full join is a merge of sorted runs where they lie.
            merged = older.alias("a").join(held[1].alias("b"), "key", "full_outer").selectExpr("key", "coalesce(a.n_docs, b.n_docs) n_docs", "coalesce(a.max_doc, b.max_doc) max_doc")
            before, held = held, self._write(merged)
            self._drop(before[0])
            self._drop(name)
            level += 1
        self.levels[level] = held

    def frequent(self, min_docs: int) -> DataFrame:
        """(key, n_docs, max_doc) of the keys in at least min_docs documents."""
        out = []
        for rows in self.runs():
            for _, t in self.log:
                rows = rows.alias("a").join(t.alias("b"), "key", "left").selectExpr("key", "a.n_docs + coalesce(b.n_docs, 0) n_docs", "greatest(a.max_doc, b.max_doc) max_doc")
            out.append(rows.where(F.col("n_docs") >= min_docs))
        return reduce(lambda a, b: a.unionAll(b), out)

    def close(self) -> None:
        for name, _ in [*self.levels.values(), *self.log]:
            self._drop(name)
        self.levels, self.log = {}, []


def drop_repeated_lines(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5, batches: int = 4, hot: int = 2000, keep: list[str] | None = None) -> DataFrame:
    """docs with text rid of its repeated lines, n_lines (before) and n_dropped."""
    spark = docs.sparkSession

    def keys(parts):
        for b in slices(parts):
            ids, found = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if len(text) >= min_chars:
                    own = {line_key(x, min_chars) for x in text.split("\n")} - {None}
                    ids += [doc] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"])

    lines = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(keys, "doc_id long, key binary").distinct()
    lines = scratch.save(lines.withColumn("batch", F.expr(f"pmod(xxhash64(doc_id, 3), {batches})")), "lines")
    runs = LineRuns(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", "key"))
    often = scratch.save(runs.frequent(min_docs), "often")
    runs.close()
    gone = hot_join(lines.select("doc_id", "key"), often, ["key"], "n_docs", hot)
    gone = gone.where("doc_id <> max_doc").groupBy("doc_id").agg(F.collect_set("key").alias("gone__"))

    def make():
        def clean(batch):
            n_lines, n_dropped, texts = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone__").to_pylist()):
                ls = (text or "").split("\n")
                n_lines.append(len(ls))
                if gone:
                    gone = set(gone)
                    stay = [x for x in ls if line_key(x, min_chars) not in gone]
                    n_dropped.append(len(ls) - len(stay))
                    texts.append("\n".join(stay))
                else:
                    n_dropped.append(0)
                    texts.append(text)
            return [np.array(n_lines), np.array(n_dropped), pa.array(texts, pa.string())]

        return clean

    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_lines", "n_dropped")]
    picked = docs.select(*dict.fromkeys([*names, "doc_id", "text"])).join(gone, "doc_id", "left")
    out = with_python(picked, make, "n_lines long, n_dropped long, text_ string", [*dict.fromkeys([*names, "text", "gone__"])])
    return out.select(*[F.col("text_").alias("text") if c == "text" else F.col(c) for c in names], "n_lines", "n_dropped")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, Scratch(spark)).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(coalesce(text, ''), 256) kept_sha256")


_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6_SQL = f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from d),
k as (select *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
f as (select k, max(doc_id) m from k where length(k) >= 40 and doc_id is not null group by k having count(distinct doc_id) >= 5),
x as (select k.r, k.doc_id, k.i, k.line, (f.k is not null and k.doc_id <> f.m) gone from k left join f on k.k = f.k)
select doc_id, count(*) n_lines, count(*) filter (coalesce(gone, false)) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not coalesce(gone, false)), '')) kept_sha256
from x group by r, doc_id
"""


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text. Null texts, and rows with a null doc_id, stay as they are; no document goes."""
    out = drop_repeated_lines(docs, Scratch(spark))
    return out.withColumn("n_chars", F.expr("if(n_dropped > 0, cast(char_length(text) as bigint), n_chars)")).select(*docs.columns)
