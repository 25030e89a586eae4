"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts anywhere else goes.

1. Every window of `length` bytes is owned by the smallest-hashed `gram`-byte string in it, its anchor. Neighbouring windows of one
   anchor are a segment. Equal windows have equal anchors, so a window can only repeat within the rows of one anchor hash.
2. Segments whose anchor occurs once are done. Equal segments of one anchor (by a 64-bit hash) are counted by a map-side
   aggregation, so that copies come to the next step as one string with a number; a string of number 2 or more repeats as a whole.
3. Distinct segments that share an anchor are cut down to the windows whose rolling hash repeats, and those strings are
   sorted by a suffix array; neighbours in it with equal first `length` bytes are the repeats. The hash only leaves out: bytes decide.
4. Each document's repeats are merged into spans and cut out.

The suffix array is built by linear grouping. Suffixes are grouped by their first symbol, and the groups are processed in descending
order: each suffix of a group points to the last place before it in a smaller group (pointers over greater groups are followed, so that no
text is compared), and the suffixes pointed to are split off their own groups, the most often pointed to last. Then all suffixes of a
group have the same longest Lyndon prefix, and one more walk over the pointers emits each group's order; nothing is renamed and
nothing recurses. Time and memory are linear whatever the text.

An anchor with more than `most` distinct segments isn't brought together: its windows are counted by 128-bit hashes with
map-side aggregation instead, which gives the same spans and has no bound. Anchors and kinds of segments in more than one of `hot` rows are
so few (at most `hot`) that they are broadcast to their rows; the others meet theirs by a shuffle.

Defined cases: null texts are empty; texts shorter than `length` keep all bytes. Rows with one doc_id, or none, are documents of their own.
Matches never cross documents. Other columns pass through; n_bytes, spans and kept are replaced.
"""

from __future__ import annotations

from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, hot_join, mix, slices, table
from dependra.llm.neardup import grouped

#: Window starts that are handled at a time, so that very long texts take no more memory.
CHUNK = 400_000
_ODD = 0x9E3779B97F4A7C15


class Rolling:
    """Polynomial hashes mod 2**64 of all substrings of one length."""

    def __init__(self, most: int):
        def powers(base: int) -> np.ndarray:
            factors = np.full(most + 1, base, np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                return np.cumprod(factors, dtype=np.uint64)

        self.up, self.down = powers(_ODD), powers(pow(_ODD, -1, 2**64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.up[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[length:] - sums[:-length]) * self.down[: len(sums) - length])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, from running minima to either side of every width-th place."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes, length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor hash of each segment of a text."""
    starts, counts, anchors = [], [], []
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - base), base)
        v = rolling.hashes(rolling.sums(part), gram)
        width = length - gram + 1
        low = sliding_min(v, width)
        # The owner is the first place in the window that has its minimum: places where the minimum of some window stands.
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(~sliding_min(~np.concatenate([edge, low, edge]), width)[: len(v)] == v)
        own = np.searchsorted(places, np.arange(len(low)))
        todo = np.flatnonzero(v[places[own]] != low)
        while len(todo):
            own[todo] += 1
            todo = todo[v[places[own[todo]]] != low[todo]]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        starts.append(first + base)
        counts.append(np.diff(np.concatenate([first, [len(low)]])))
        anchors.append(v[places[own[first]]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def suffix_order(text: list[int]) -> list[int] | array:
    """The places of all suffixes in lexicographic order. text: symbols from 0 to 257, of which the last is the smallest and occurs once."""
    n = len(text)
    count = [0] * 258
    for c in text:
        count[c] += 1
    begins, at = [0] * 258, 0
    for c, k in enumerate(count):
        begins[c] = at
        at += k
    # Groups lie in `order` one after the other; group: where a suffix's group begins, size: by where a group begins.
    ints = list if n < 1_000_000 else partial(array, "i")  # lists are faster, arrays take less memory
    zeros = ints([0]) * n
    group, size, order, place = ints(map(begins.__getitem__, text)), zeros[:], zeros[:], zeros[:]
    for c, k in enumerate(count):
        if k:
            size[begins[c]] = k
    for i, c in enumerate(text):
        at = begins[c]
        order[at], place[i] = i, at
        begins[c] = at + 1
    smaller = ints([-2]) * n  # the last place before a suffix that is in a smaller group; -2: not known yet
    end = n
    while end:
        begin = group[order[end - 1]]
        named: dict[int, int] = {}
        for i in order[begin:end]:
            j = smaller[i]
            if j == -2:
                j, passed = i - 1, [i]
                while j >= 0 and group[j] >= begin:
                    if smaller[j] != -2:
                        j = smaller[j]
                    else:  # of this group, as all greater ones are done
                        passed.append(j)
                        j -= 1
                for x in passed:
                    smaller[x] = j
            if j >= 0:
                named[j] = named.get(j, 0) + 1
                only = j
        if len(named) == 1:  # the most frequent case: one suffix is split off
            j = only
            g = group[j]
            size[g] -= 1
            last, here = g + size[g], place[j]
            other = order[last]
            order[last], order[here], place[j], place[other], group[j] = j, other, last, here, last
            size[last] += 1
            end = begin
            continue
        levels: dict[int, list[int]] = {}
        for j, k in named.items():
            levels.setdefault(k, []).append(j)
        for k in sorted(levels, reverse=True):
            # To the end of their groups, which become groups of their own behind the rest.
            for j in levels[k]:
                size[group[j]] -= 1
                last, here = group[j] + size[group[j]], place[j]
                other = order[last]
                order[last], order[here], place[j], place[other] = j, other, last, here
            moved = [group[j] + size[group[j]] for j in levels[k]]
            for j, g in zip(levels[k], moved):
                group[j] = g
            for g in moved:
                size[g] += 1
        end = begin
    # Each suffix in order gives the next places of their groups to those that stand before it, back over the pointers.
    out, front, done = zeros, ints(range(n)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            out[front[group[j]]] = j
            front[group[j]] += 1
            done[j] = 1
            j = smaller[j]
    return out


def suffix_array(strings: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The strings end to end, each with a mark behind it, and the places of all suffixes in order; a mark is smaller than any byte."""
    text = np.concatenate([np.zeros(0, np.int64), *(x for s in strings for x in (np.frombuffer(s, np.uint8).astype(np.int64) + 2, [1])), [0]])
    return b"".join(s + b"\0" for s in strings), np.array(suffix_order(text.tolist()), np.int64)[1:]


def repeats(texts: list[bytes], length: int, rolling: Rolling) -> list[np.ndarray]:
    """For each of several distinct texts, whether the string of `length` bytes at a place occurs in another place too."""
    counts = [max(0, len(t) - length + 1) for t in texts]
    hashes = [rolling.hashes(rolling.sums(np.frombuffer(t, np.uint8)), length) if c else np.zeros(0, np.uint64) for t, c in zip(texts, counts)]
    together = np.concatenate(hashes)
    _, which, seen = np.unique(together, return_inverse=True, return_counts=True)
    likely = seen[which] > 1
    out = [np.zeros(c, bool) for c in counts]
    # The runs of likely windows are what is sorted; equal runs are sorted once.
    runs: dict[bytes, list[tuple[int, int]]] = {}
    at = 0
    for k, c in enumerate(counts):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], likely[at : at + c], [False]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            runs.setdefault(texts[k][a : b - 1 + length], []).append((k, a))
        at += c
    strings = list(runs)
    begins = np.cumsum([0, *(len(s) + 1 for s in strings)])
    data, order = suffix_array(strings)
    whole = np.zeros(len(data), bool)  # where a window begins
    hit = np.zeros(len(data), bool)
    for s, at in zip(strings, begins.tolist()):
        whole[at : at + len(s) - length + 1] = True
        hit[at : at + len(s) - length + 1] = len(runs[s]) > 1
    last = None
    for i in order[whole[order]].tolist():
        now = data[i : i + length]
        if last is not None and now == last[1]:
            hit[i] = hit[last[0]] = True
        last = (i, now)
    for s, at in zip(strings, begins.tolist()):
        for k, a in runs[s]:
            out[k][a : a + len(s) - length + 1] |= hit[at : at + len(s) - length + 1]
    return out


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans covered by intervals; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])].tolist()))


def drop_repeated_substrings(docs: DataFrame, scratch: Scratch, length: int = 200, gram: int = 64, most: int = 20_000, hot: int = 2000, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes, spans (array of struct start, end: what was removed) and kept (the remaining bytes)."""
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_bytes", "spans", "kept", "rid__")]
    docs = docs.select(*dict.fromkeys([*names, "doc_id", "text"]))
    n = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n[0] == n[1] == n[2]:
        docs = docs.withColumn("rid__", F.col("doc_id").cast("long"))
    else:  # rows get names of their own, held in a table
        docs = scratch.save(docs.withColumn("rid__", F.monotonically_increasing_id()), "rows")
    texts = docs.where(f"octet_length(text) >= {length}").selectExpr("rid__ rid", "text")

    def cut(batches):
        rolling = Rolling(CHUNK + length)
        for b in slices(batches):
            rid, xm, anchor, whole = [], [], [], []
            for r, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                x, m, a = segments(data, length, gram, rolling)
                rid.append(np.full(len(x), r, np.int64))
                xm.append(x << 20 | m)
                anchor.append(a.view(np.int64))
                whole += [xxhash.xxh3_64_intdigest(data[i : i + k - 1 + length]) for i, k in zip(x.tolist(), m.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (rid, anchor)] + [pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(np.concatenate(xm))], names=["rid", "a", "c", "xm"])

    segs = scratch.save(texts.mapInArrow(cut, "rid long, a long, c long, xm long"), "segments")
    multi = scratch.save(segs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    found = scratch.save(hot_join(segs, multi, ["a"], "n", hot).drop("n"), "found")
    scratch.drop("segments")
    scratch.collect_garbage()
    kinds = scratch.save(found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "xm")).alias("e")).selectExpr("a", "c", "n", "e.rid rid", "e.xm xm"), "kinds")
    # Segments that occur twice repeat as a whole.
    whole = hot_join(found, kinds.where("n > 1").select("a", "c", "n"), ["a", "c"], "n", hot)
    hits = [whole.selectExpr("rid", "shiftright(xm, 20) s", f"shiftright(xm, 20) + (xm & 1048575) - 1 + {length} e")]
    # Distinct segments of one anchor are compared.
    wide = kinds.groupBy("a").agg(F.count("*").alias("k")).where("k > 1")
    wide = scratch.save(hot_join(kinds, wide, ["a"], "k", hot).select("a", "n", "k", "rid", "xm"), "wide")
    places = wide.groupBy("rid").agg(F.collect_list(F.struct("a", "n", "k", "xm")).alias("ps"))

    def contexts(batches):
        for b in slices(batches):
            rows = []
            for r, text, ps in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("ps").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for p in ps:
                    x, m = p["xm"] >> 20, p["xm"] & 1048575
                    rows.append((p["a"], p["n"], p["k"], r, x, data[x : x + m - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.int64()] * 5, pa.binary()))], names=["a", "n", "k", "rid", "x", "data"])

    held = texts.join(places, "rid").mapInArrow(contexts, "a long, n long, k long, rid long, x long, data binary")
    held = scratch.save(held, "contexts")
    scratch.collect_garbage()
    hits.append(_by_suffix_array(held.where(F.col("k") <= most), length))
    if wide.where(F.col("k") > most).limit(1).count():
        hits.append(_by_hash(held.where(F.col("k") > most), length))
    spans = hits[0]
    for h in hits[1:]:
        spans = spans.unionAll(h)
    spans = scratch.save(spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans__")), "spans")
    for name in ("found", "kinds", "wide", "contexts", "anchors"):
        scratch.drop(name)
    scratch.collect_garbage()
    return _cut_out(docs.join(spans, F.expr("rid__ = rid"), "left"), names)


def _by_suffix_array(held: DataFrame, length: int) -> DataFrame:
    def run(batches):
        rolling = Rolling(CHUNK + length)
        for g in grouped(batches, ["a"]):
            rid, x, n, data = (g.column(c).to_pylist() for c in ("rid", "x", "n", "data"))
            rows = []
            for r, at, k, hit in zip(rid, x, n, repeats(data, length, rolling)):
                if k == 1 and hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))) + at
                    rows += [(r, s, e - 1 + length) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rid", "s", "e"])

    dealt = held.select("a", "n", "rid", "x", "data").repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "rid long, s long, e long")


def _by_hash(held: DataFrame, length: int) -> DataFrame:
    """The exact way for anchors with very many segments: a row for each window."""

    def run(batches):
        for b in slices(batches, "data"):
            rows = [(xxhash.xxh3_128_digest(d[i : i + length]), r, x + i) for r, x, d in zip(*(b.column(c).to_pylist() for c in ("rid", "x", "data"))) for i in range(len(d) - length + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["h", "rid", "s"])

    windows = held.mapInArrow(run, "h binary, rid long, s long")
    often = windows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    return windows.join(often, "h", "left_semi").selectExpr("rid", "s", f"s + {length} e")


def _cut_out(docs: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            sizes, spans, kept = [], [], []
            column = b.column("spans__")
            for text, k in zip(b.column("text").to_pylist(), range(b.num_rows)):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                own = []
                if column[k].is_valid:
                    pairs = column[k].values
                    own = spans_of(*(pairs.field(i).to_numpy() for i in (0, 1)))
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in own])
                cuts = [0, *(p for s in own for p in s), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    return docs.select(*dict.fromkeys([*names, "text", "spans__"])).mapInArrow(run, schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), keep=["doc_id"])
    return out.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) n_removed", "cast(size(spans) as long) n_spans", "sha2(kept, 256) kept_sha256")


OP9_SQL = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
w as materialized (select r, p, md5(substr(h, 2 * p + 1, 400)) x from (select r, h, unnest(range(0, n - 199)) p from d where n >= 200)),
g as (select r, p, lag(p) over (partition by r order by p) l from w where x in (select x from w group by x having count(*) > 1)),
s as (select r, min(p) s, max(p) + 200 e from (select r, p, count(*) filter (l is null or p > l + 200) over (partition by r order by p) k from g) group by r, k),
b as (select r, s, e, lag(e, 1, 0) over (partition by r order by s) z from s),
k as (select r, count(*) n_spans, sum(e - s) n_removed, max(e) e, string_agg(substr(h, 2 * z + 1, 2 * (s - z)), '' order by s) t from b join d using (r) group by r)
select doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(e, 0) + 1))) kept_sha256
from d left join k using (r)
"""
