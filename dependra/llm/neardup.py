"""Near duplicates by SetSketch registers.

A document's set of word shingles is sketched by `registers` exponentially spaced truncated minima: every element sends
out a Poisson stream of points over the registers, a register keeps its smallest, x, and stores clip(1 - log_b(x)).
Sketches merge by the larger register. Equal registers are locality-sensitive, so bands of register values name candidates.
A pair's similarity is estimated jointly from both sketches and set sizes by maximum likelihood; pairs that the estimate can't
rule out are confirmed on their full sets, rebuilt from the whole texts.

Documents with equal sets make one class, by a map-side aggregation; only classes go on. The members of a band's bucket
are first linked with the bucket's smallest, which is linear. Then buckets that still hold more than one component
have all their pairs between components compared in blocks within a task: at first sketches alone, then, with the full sets, those
members that the sketches leave a partner. Only links leave a task. So every candidate pair is either inside one component
already or confirmed. Nothing is capped.

Bands are of 4, 2 or 1 registers, the most for which a pair at the threshold is missed with a chance of at most 1e-6 (4 at 0.8: 5e-8).
At thresholds under 0.11 no width reaches that, and the misses grow.

Defined cases: a text with fewer words than a shingle has the whole sequence as its one shingle; null, empty and blank
texts have none and are linked with nothing. Rows with one doc_id are linked through it; each is reported. Rows with a null doc_id are
reported with their size, a null component, kept, and are linked with nothing. An empty table gives no rows.
Other columns pass through drop_near_duplicates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, WordHashes, component_labels, mix, shingles, slices, table, words

REGISTERS = 128
BASE, SHIFT, TOP = 1.02, 400, 2400


def sketch(values: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers of many sets at once (uint16, one row a set); sets are arrays of distinct 64-bit hashes."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    low = np.full((len(values), registers), np.inf)
    flat = low.reshape(-1)
    if sizes.sum():
        state = np.concatenate(values)
        own = np.repeat(np.arange(len(values)), sizes)
        x = np.zeros(len(state))
        with np.errstate(over="ignore"):
            while len(state):
                state = mix(state + np.uint64(0x9E3779B97F4A7C15))
                x -= np.log(((state >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / registers
                at = mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)
                np.minimum.at(flat, own * registers + at.astype(np.int64), x)
                go = np.flatnonzero(x < low.max(axis=1)[own])
                state, own, x = state[go], own[go], x[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(BASE)) + SHIFT
    return np.clip(k, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_GRID = np.concatenate([np.linspace(0, 0.7, 15), np.linspace(0.72, 1, 15)])


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, slack: float = 25.0) -> np.ndarray:
    """Whether the joint likelihood lets the Jaccard similarity be at least `similarity`.

    a, b: rows of registers; na, nb: set sizes. Twice the log-likelihood's loss at the threshold against its maximum may be at
    most slack (five standard deviations). The sizes also bound the similarity exactly.
    """
    m, c = a.shape[1], (BASE - 1) / BASE
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def at(j):
        j = np.minimum(j, top)
        p = np.clip(-np.log1p(-c * (u - v * j)) / np.log(BASE), 1e-12, 1)
        q = np.clip(-np.log1p(-c * (v - u * j)) / np.log(BASE), 1e-12, 1)
        return more * np.log(p) + less * np.log(q) + (m - more - less) * np.log(np.maximum(1 - p - q, 1e-12))

    ll = np.stack([at(j) for j in _GRID])
    good = ll[_GRID >= similarity - 1e-9].max(axis=0)
    return (top >= similarity - 1e-9) & (2 * (ll.max(axis=0) - good) <= slack)


def band_width(similarity: float) -> int:
    """Registers in a band."""
    return next((w for w in (4, 2) if (1 - similarity**w) ** (REGISTERS // w) <= 1e-6), 1)


def band_keys(sketches: bytes, width: int) -> np.ndarray:
    """The bucket of every band of sketches laid end to end, a row for each sketch."""
    rows = np.frombuffer(sketches, {4: np.uint64, 2: np.uint32, 1: np.uint16}[width]).reshape(-1, REGISTERS // width).astype(np.uint64)
    return mix(rows ^ mix(np.arange(1, REGISTERS // width + 1).astype(np.uint64))).view(np.int64)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, set_hash, sketch) of every row; set_hash and sketch are null without a shingle."""

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches):
            sets = [shingles(hashes.of(words(t)), size) for t in b.column("text").to_pylist()]
            rows = sketch(sets)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if k else None for s, k in zip(sets, some)], pa.binary()),
                pa.array([r.tobytes() if k else None for r, k in zip(rows, some)], pa.binary())], names=["doc_id", "n", "set_hash", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_hash binary, sketch binary")


def _bands(classes: DataFrame, width: int) -> DataFrame:
    """(rep, bucket): one row for every band of a class."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(b"".join(b.column("sketch").to_pylist()), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], names=["rep", "bucket"])

    return classes.select("rep", "sketch").mapInArrow(run, "rep long, bucket long")


def _verified(scratch: Scratch, name: str, pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar: first by the sketches, then by the full sets."""
    percent = round(similarity * 100)
    c = classes.select("rep", "n", "sketch")
    pairs = pairs.join(c.selectExpr("rep a", "n na", "sketch sa"), "a").where("na > 0").join(c.selectExpr("rep b", "n nb", "sketch sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def rough(batches):
        for t in batches:
            if t.num_rows:
                sa, sb = (np.frombuffer(b"".join(t.column(x).to_pylist()), np.uint16).reshape(t.num_rows, -1) for x in ("sa", "sb"))
                ok = plausible(sa, sb, t.column("na").to_numpy(), t.column("nb").to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([t.column(x) for x in ("a", "b")], names=["a", "b"]).filter(pa.array(ok))

    def exact(batches):
        hashes, held = WordHashes(), {}

        def full(doc, text):
            if doc not in held:
                if len(held) >= 16:
                    held.clear()
                held[doc] = shingles(hashes.of(words(text)), size)
            return held[doc]

        for t in batches:
            ok = []
            for a, b, ta, tb in zip(*(t.column(x).to_pylist() for x in ("a", "b", "ta", "tb"))):
                sa, sb = full(a, ta), full(b, tb)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                ok.append(100 * common >= percent * (len(sa) + len(sb) - common))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = pairs.mapInArrow(rough, "a long, b long")
    held = pairs.join(texts.selectExpr("doc_id a", "text ta"), "a").join(texts.selectExpr("doc_id b", "text tb"), "b").select("a", "b", "ta", "tb")
    out = scratch.save(held.mapInArrow(exact, "a long, b long"), name)
    scratch.collect_garbage()
    return out


def grouped(batches, keys: list[str]):
    """Tables of equal keys from record batches sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield t.slice(i, j - i)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


_PIECE = ("bucket", "kind", "i", "j")
_MEMBER = "bucket long, kind int, i int, j int, rep long, comp long, main boolean, blk int, size long, sketch binary"


class _Piece:
    """The members of two blocks of a bucket (of one, if kind is 1 and i = j), and which of them are to be compared."""

    def __init__(self, g: pa.Table, similarity: float, width: int):
        self.kind, self.i, self.j, self.bucket = (g.column(c)[0].as_py() for c in ("kind", "i", "j", "bucket"))
        self.rep, label, self.blk, self.n = (g.column(c).to_numpy() for c in ("rep", "comp", "blk", "size"))
        self.label, self.main = label.copy(), np.array(g.column("main").to_pylist(), bool)
        raw = b"".join(g.column("sketch").to_pylist())
        self.s, self.keys = np.frombuffer(raw, np.uint16).reshape(g.num_rows, -1), band_keys(raw, width)
        self.similarity = similarity
        # Ten standard deviations below what a pair at the threshold has in common.
        self.least = (similarity - 10 * np.sqrt(similarity * (1 - similarity) / REGISTERS)) * REGISTERS

    def __iter__(self):
        return (x for x in range(len(self.rep)) if self.kind or not self.main[x])

    def partners(self, x: int, among: np.ndarray | bool = True) -> np.ndarray:
        """Those of another component that x is compared with here and that sizes and sketches don't rule out."""
        ok = (self.label != self.label[x]) & among
        ok &= self.main if not self.kind else (self.blk > self.blk[x]) if self.i != self.j else (self.rep > self.rep[x])
        y = np.flatnonzero(ok)
        # The exact bound by sizes, then the bucket that has the pair (the smallest that it shares), then the sketches.
        y = y[np.minimum(self.n[y], self.n[x]) >= self.similarity * np.maximum(self.n[y], self.n[x]) - 1e-9]
        last = np.iinfo(np.int64).max
        y = y[np.where(self.keys[y] == self.keys[x], self.keys[y], last).min(axis=1, initial=last) == self.bucket]
        y = y[(self.s[y] == self.s[x]).sum(axis=1) >= self.least]
        if len(y):
            y = y[plausible(np.broadcast_to(self.s[x], (len(y), self.s.shape[1])), self.s[y], np.full(len(y), self.n[x]), self.n[y], self.similarity)]
        return y


def _across(buckets: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, size: int, similarity: float, block: int = 1024) -> DataFrame:
    """Links (a, b) that join the different components within buckets (rep, comp, bucket, size).

    The members of a bucket's largest component and the others are dealt into blocks of `block` or so; every pair of blocks
    with others in it is one piece of a task's work. First the pieces get ids and sketches, and only the members that have a
    possible partner in a piece stay in it. Then the full sets of these come along. A pair is looked at in the smallest bucket that it
    shares. As soon as two components are linked, their other pairs are left out, so a piece emits fewer rows than it has components.
    """
    percent, width = round(similarity * 100), band_width(similarity)
    counts = buckets.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(rep))").alias("who"))
    open_ = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("m"), F.expr("bit_xor(who)").alias("who"), F.count("*").alias("comps")).where("comps > 1")
    # Buckets with the same members need one look: at the smallest.
    open_ = open_.groupBy("who", "n", "m").agg(F.min("bucket").alias("bucket"))
    open_ = open_.selectExpr("bucket", "m.comp most", f"cast(ceil(m.k / {block}) as int) na", f"cast(ceil((n - m.k) / {block}) as int) nb")
    rows = buckets.join(open_, "bucket").withColumn("main", F.expr("comp = most")).withColumn("blk", F.expr("cast(pmod(xxhash64(rep), if(main, na, nb)) as int)"))
    rows = rows.join(classes.selectExpr("rep r2", "sketch"), F.expr("rep = r2"))
    rows = rows.withColumn("at", F.expr("""explode(if(main, transform(sequence(0, nb - 1), o -> named_struct('kind', 0, 'i', blk, 'j', o)),
        concat(transform(sequence(0, na - 1), o -> named_struct('kind', 0, 'i', o, 'j', blk)), transform(sequence(0, nb - 1), o -> named_struct('kind', 1, 'i', least(blk, o), 'j', greatest(blk, o))))))"""))
    rows = rows.select("bucket", "at.*", "rep", "comp", "main", "blk", "size", "sketch")

    def possible(batches):
        for g in grouped(batches, list(_PIECE)):
            piece, stay = _Piece(g, similarity, width), np.zeros(g.num_rows, bool)
            for x in piece:
                y = piece.partners(x, ~stay if stay[x] else True)  # who stays needs no second partner
                if len(y):
                    stay[x] = stay[y] = True
            yield from g.filter(pa.array(stay)).combine_chunks().to_batches()

    names = [f.split()[0] for f in _MEMBER.split(", ")]
    dealt = rows.select(*names).repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    near = scratch.save(dealt.mapInArrow(possible, _MEMBER), "near")

    def sets(batches):
        hashes = WordHashes()
        for b in slices(batches):
            full = [shingles(hashes.of(words(t)), size).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(full, pa.binary())], names=["r3", "full"])

    few = texts.join(near.select("rep").distinct(), F.expr("doc_id = rep"), "left_semi").select("doc_id", "text").mapInArrow(sets, "r3 long, full binary")

    def confirmed(batches):
        for g in grouped(batches, list(_PIECE)):
            piece, full, out = _Piece(g, similarity, width), g.column("full"), []
            for x in piece:
                y = piece.partners(x)
                mine = np.frombuffer(full[x].as_py(), np.uint64) if len(y) else None
                for z in y.tolist():
                    if piece.label[z] == piece.label[x]:
                        continue
                    both = len(np.intersect1d(mine, np.frombuffer(full[z].as_py(), np.uint64), assume_unique=True))
                    if 100 * both >= percent * (piece.n[x] + piece.n[z] - both):
                        out.append(sorted((int(piece.rep[x]), int(piece.rep[z]))))
                        piece.label[piece.label == piece.label[z]] = piece.label[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[q] for p in out], pa.int64()) for q in (0, 1)], names=["a", "b"])

    dealt = near.join(few, F.expr("rep = r3")).select(*names, "full").repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    return dealt.mapInArrow(confirmed, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept; a row for each of docs."""
    docs = docs.select("doc_id", "text")
    rows = scratch.save(document_sets(docs, size), "sets")
    some = rows.where("set_hash is not null and doc_id is not null")
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # One doc_id can stand for two classes if it has two texts: the class then goes by its own name, the doc_id links them.
    classes = scratch.save(classes, "named")
    twice = some.groupBy("doc_id").agg(F.count_distinct("set_hash").alias("k")).where("k > 1").limit(1).count() > 0
    if twice:
        return _with_repeated_ids(docs, scratch, size, similarity)
    buckets = scratch.save(_bands(classes, band_width(similarity)).distinct(), "bands")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
    shared = scratch.save(buckets.join(shared, "bucket"), "shared")
    scratch.drop("bands")
    # The texts of all that shares a bucket: what the confirmations read.
    some = shared.selectExpr("rep id").distinct()
    texts = scratch.save(docs.where("doc_id is not null").join(some, F.expr("doc_id = id"), "left_semi"), "texts")
    scratch.collect_garbage()
    star = shared.where("rep <> low").selectExpr("low a", "rep b").distinct()
    links = _verified(scratch, "links", star, classes, texts, size, similarity)
    nodes = classes.selectExpr("rep id")
    comps = scratch.save(component_labels(scratch, nodes, links, "cc1"), "comps1")
    held = shared.join(comps.selectExpr("id rep", "component comp"), "rep").join(classes.selectExpr("rep r1", "n size"), F.expr("rep = r1"))
    held = scratch.save(held.select("rep", "comp", "bucket", "size"), "held")
    scratch.drop("shared")
    more = scratch.save(_across(held, classes, texts, scratch, size, similarity).distinct(), "more")
    if more.limit(1).count():
        # Carried on from the first components.
        comps = scratch.save(component_labels(scratch, nodes, comps.where("id <> component").selectExpr("id a", "component b").unionAll(more), "cc2"), "comps2")
    for name in ("links", "held", "texts", "near", "more"):
        scratch.drop(name)
    scratch.collect_garbage()
    named = classes.select("set_hash", "rep").join(comps, F.expr("rep = id")).selectExpr("set_hash h", "component")
    out = rows.select("doc_id", "n", "set_hash").join(named, F.expr("set_hash = h and doc_id is not null"), "left")
    return out.selectExpr("doc_id", "n n_shingles", "coalesce(component, doc_id) component_id", "coalesce(doc_id = coalesce(component, doc_id), true) kept")


def _with_repeated_ids(docs: DataFrame, scratch: Scratch, size: int, similarity: float) -> DataFrame:
    """The general case, in which a doc_id has several texts: rows get names of their own, then ids are linked through them."""
    inner = Scratch(scratch.spark)
    keyed = docs.where("doc_id is not null").withColumn("h", F.expr("cast(xxhash64(doc_id, text is null, coalesce(text, '')) as long)"))
    keyed = scratch.save(keyed.dropDuplicates(["h"]), "keyed")
    by_name = near_duplicates(keyed.selectExpr("h doc_id", "text"), inner, size, similarity)
    named = scratch.save(by_name.selectExpr("doc_id h", "n_shingles", "component_id c").join(keyed.select("h", "doc_id"), "h"), "rows")
    low = named.where("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("low"))
    edges = named.join(low, "c").selectExpr("low a", "doc_id b").distinct()
    comps = component_labels(scratch, named.selectExpr("doc_id id").distinct(), edges, "cc3")
    sizes = named.groupBy("h").agg(F.first("n_shingles").alias("n_shingles"))
    rows = docs.withColumn("h", F.expr("if(doc_id is null, null, cast(xxhash64(doc_id, text is null, coalesce(text, '')) as long))"))
    nulls = document_sets(rows.where("doc_id is null"), size).selectExpr("doc_id", "n n_shingles", "cast(null as long) component_id", "true kept")
    out = rows.where("doc_id is not null").select("doc_id", "h").join(sizes, "h").join(comps, F.expr("doc_id = id"))
    return out.selectExpr("doc_id", "n_shingles", "component component_id", "doc_id = component kept").unionAll(nulls)


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (and, of rows with that id, one)."""
    found = scratch.save(near_duplicates(docs, scratch, size, similarity), "found")
    gone = found.where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*").select(*docs.columns).unionAll(out.where("doc_id is null"))
    return out


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), size=2)


OP3_SQL = """
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
s as materialized (select doc_id, list_sort(list_distinct(case when len(ws) < 2 then list_transform(ws, lambda x: x) else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end)) ss from w),
c as materialized (select min(doc_id) rep, ss, len(ss) n from s where len(ss) > 0 group by ss),
u as materialized (select rep, n, unnest(ss) x from c),
f as (select x, count(*) df from u group by x),
p as materialized (select rep, n, x from (select rep, n, u.x, row_number() over (partition by rep order by df, u.x) i from u join f on u.x = f.x) where i <= n - ceil(0.8 * n) + 1),
pairs as materialized (select distinct a.rep a, b.rep b, a.n na, b.n nb from p a join p b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e as materialized (select a, b from pairs join u x on x.rep = a join u y on y.rep = b and y.x = x.x group by a, b, na, nb having 100 * count(*) >= 80 * (na + nb - count(*))),
r(a, b) as (select rep, rep from c union select r.a, g.b from r join (select a, b from e union all select b, a from e) g on r.b = g.a),
m as (select a rep, min(b) low from r group by a)
select s.doc_id, len(s.ss) n_shingles, coalesce(low, s.doc_id) component_id, s.doc_id = coalesce(low, s.doc_id) kept
from s left join c on s.ss = c.ss left join m on m.rep = c.rep
"""


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays: the one with the smallest doc_id, and one row of
    it. Rows with a null doc_id, and texts without words, stay."""
    return drop_near_duplicates(docs, Scratch(spark))
