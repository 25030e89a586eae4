"""What the training-data operators share: shared scratch tables, word rules and stable hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker turns into arrays at a time.
SLICE_BYTES = 2_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


#: Rows and bytes of text in a record batch on its way to Python: with these a worker's memory doesn't depend on the texts' lengths,
#: but for a single text.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder of spark.checkpoint.dir (a temporary folder where that is unset and the master local, as in tests).

    A table written here cuts the lineage: a lost executor costs its own tasks only.
    All tables of a run lie under one folder, which goes when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="dependra-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/dependra-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def collect_garbage(self) -> None:
        """Lets Spark delete the shuffle files of plans whose results have been written."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str | None = None) -> None:
        """Removes one table, or all of them."""
        try:
            jvm, to = self.spark._jvm, f"{self.root}/{name}" if name else self.root
            path = jvm.org.apache.hadoop.fs.Path(to)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before the interpreter
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than size: one shingle of all; no words: none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = mix(h * _GOLD + hashes[i : i + n])
    return np.unique(h)


def slices(batches, text: str = "text"):
    """Record batches cut so that each holds about SLICE_BYTES of text, whole texts always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def component_labels(scratch: Scratch, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); nodes (id) without edges are their own.

    Alternating large-star and small-star steps: every step is one aggregation and one join on ids, no neighbourhood is
    collected, and the number of steps grows with the logarithm of the longest path. Each step is a written table.
    """
    from pyspark.sql import functions as F

    now = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), f"{name}_0")
    seen, step = None, 0
    while True:
        step += 1
        both = now.selectExpr("u", "v").unionAll(now.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v u", "m v").where("u <> v").unionAll(low.selectExpr("u", "m v")).distinct()
        now = scratch.save(small.selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), f"{name}_{step}")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        scratch.drop(f"{name}_{step - 1}")
        if state == seen:
            break
        seen = state
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("m")), nodes["id"] == F.col("u"), "left").selectExpr("id", "coalesce(m, id) component")


def hot_join(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, hot: int = 2000) -> DataFrame:
    """rows joined with counts, whose column n says how many of rows have its keys.

    Keys in more than one of `hot` rows are at most `hot` in number: these are broadcast. All others meet their rows by a shuffle, in which
    none of them is large.
    """
    from pyspark.sql import functions as F

    bound = rows.count() / hot
    few = counts.where(F.col(n) > bound)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(counts.where(F.col(n) <= bound), keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def with_python(df: DataFrame, make, new: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """df's columns (or those of keep) and new ones that Python makes from slices of record batches.

    make() is called once a task and gives a function from a record batch to a list of arrays, one for each field of
    new (a DDL string). An input column with a new column's name gives way to it.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    fields = T._parse_datatype_string(new).fields
    names = {f.name.lower() for f in fields}
    out = [c for c in (keep if keep is not None else df.columns) if c.lower() not in names]
    used = out if text in out else [*out, text]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([*(df.schema[c] for c in out), *fields])

    def run(batches):
        fn = make()
        for part in slices(batches, text):
            made = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(fn(part), kinds)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), *made], names=[*out, *(f.name for f in fields)])

    return df.select(*[f"`{c}`" for c in used]).mapInArrow(run, schema)


def sampled(df: DataFrame, by: str, most: int, key: str, seed: int) -> DataFrame:
    """About `most` rows of each value of `by`, picked by a hash of `key`: all rows where there are fewer.

    Values are counted and joined where they lie; none reaches the driver, and frequent ones aren't shuffled. The rows expected of a value are
    bounded by `most`.
    """
    from pyspark.sql import functions as F

    some = df.where(F.col(by).isNotNull())
    u = F.expr(f"pmod(xxhash64({key}, {seed}), 1000000)")
    return hot_join(some, some.groupBy(by).agg(F.count("*").alias("of__")), [by], "of__").where(u < F.ceil(F.lit(most * 1_000_000) / F.col("of__"))).select(*df.columns)
