"""Readers, writers and converters of treebank formats, row caps and generated ids.

Text formats become one row a sentence (ord, original_id, rows: array of columns), then a Corpus. ord is the input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dependra.functions import tags
from dependra.sources.corpus import TOKENS, Corpus, build, with_degrees

# ---------------------------------------------------------------- places over a whole table


def placed(df: DataFrame, *order: str, weight: str | None = None) -> DataFrame:
    """df with place (from 0 in the order) and, for a weight, before (the sum of the weights of earlier rows).

    Range partitions are sorted and counted by themselves; only one row a partition is summed in one task.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid__", F.spark_partition_id()).withColumn("w__", w).persist()
    part = Window.partitionBy("pid__").orderBy(*order)
    offsets = rows.groupBy("pid__").agg(F.count("*").alias("c"), F.sum("w__").alias("s"))
    earlier = Window.orderBy("pid__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("pid__", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    rows = rows.withColumn("at__", F.row_number().over(part)).withColumn("sum__", F.sum("w__").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(offsets), "pid__")  # a row for each partition
    rows = rows.withColumn("place", F.col("at__") - 1 + F.col("c0")).withColumn("before", F.col("sum__") - F.col("w__") + F.col("s0"))
    return rows.drop("pid__", "w__", "at__", "sum__", "c0", "s0", *([] if weight else ["before"]))


def capped(sentences: DataFrame, order: str, max_sentences: int = 0, max_tokens: int = 0, size: str = "size") -> DataFrame:
    """The first max_sentences sentences, and those before which there are at most max_tokens tokens (0: no cap)."""
    rows = placed(sentences, order, weight=size)
    if max_sentences:
        rows = rows.where(F.col("place") < max_sentences)
    if max_tokens:
        rows = rows.where(F.col("before") <= max_tokens)
    return rows.drop("place", "before")


def generated_ids(sentences: DataFrame, order: str) -> DataFrame:
    return placed(sentences, order).withColumn("original_id", F.concat(F.lit("s-"), F.col("place") + 1)).drop("place")


def batched(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with batch: n rows each, in order."""
    return placed(df, order).withColumn("batch", F.floor(F.col("place") / n)).drop("place")


def sampled(df: DataFrame, p: float, seed: int | None = None) -> DataFrame:
    """Each row with the chance p."""
    return df.sample(p, seed)


def int_bins(low: int, high: int, n: int = 10) -> list[int]:
    """Edges of n equally wide integer bins (fewer if the range is short); the last edge is inclusive."""
    width = 1 if high <= low + n - 1 else -(-(high - low + 1) // n)
    edges = list(range(low, high + 2)) if width == 1 and high <= low + n - 1 else list(range(low, low + width * n + 1, width))
    return edges[:-1] + [edges[-1] - 1]


def binned(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(bin, n): rows by bin of an integer column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    edges = int_bins(low, high, n)
    width = edges[1] - edges[0] if len(edges) > 2 else 1
    return df.groupBy(F.floor((F.col(column) - low) / width).alias("bin")).agg(F.count("*").alias("n"))


def rank_correlations(rows: DataFrame, measures: list[str], item: str, digits: int | None = None) -> DataFrame:
    """(measure_1, measure_2, rho): correlations of the ranks of items; equal values share the lowest rank."""
    rows = rows.select(item, *measures).dropna()
    for m in measures:
        at = placed(rows.select(m), m).groupBy(m).agg((F.min("place") + 1).alias(f"{m}__"))
        rows = rows.join(at, m)
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]]
    one = rows.agg(*[F.corr(f"{a}__", f"{b}__").alias(f"{a}__{b}") for a, b in pairs])
    out = one.selectExpr("inline(array(" + ", ".join(f"named_struct('measure_1', '{a}', 'measure_2', '{b}', 'rho', `{a}__{b}`)" for a, b in pairs) + "))")
    return out if digits is None else out.withColumn("rho", F.round("rho", digits))


# ---------------------------------------------------------------- CoNLL-U


def read_blocks(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(ord, value): text cut at `end`. Files ending in .gz are read as such."""
    text = spark.read.text(path, lineSep=end)
    return text.where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("ord"), "value")


def with_places(lines: DataFrame) -> DataFrame:
    """value, and the file and block of a file that a line read by Spark comes from."""
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(ord, value): what stands between lines without any but blank characters, in the order of files and of places in them.

    lines: with_places() of lines in the order in which Spark reads them. Lines are put together where they are read, block of a file by
    block; only what lies over the ends of blocks, at most two pieces a block, is dealt by file and joined.
    """

    def run(batches):
        import pyarrow as pa

        names = ["path", "start", "seq", "head", "tail", "value"]
        here, held, seq, head, out = None, [], 0, False, []

        def close(tail: bool) -> None:
            nonlocal held, seq, head
            if held or head or tail:
                out.append((*here, seq, head, tail, "\n".join(held)))
                seq += 1
            held, head = [], False

        for b in batches:
            for value, path, start in zip(*(b.column(c).to_pylist() for c in ("value", "path", "start"))):
                if (path, start) != here:
                    if here is not None:
                        close(True)
                    here, seq, head = (path, start), 0, start > 0
                value = value.rstrip()
                if value:
                    held.append(value)
                else:
                    close(False)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=names)
            out = []
        if here is not None:
            close(True)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=names)

    pieces = lines.mapInArrow(run, "path string, start long, seq long, head boolean, tail boolean, value string").persist()
    inner = pieces.where("not head and not tail").selectExpr("path", "start + seq at", "value")
    over = Window.partitionBy("path").orderBy("start", "seq")
    cut = pieces.where("head or tail").withColumn("new", F.expr("not head") | ~F.coalesce(F.lag("tail").over(over), F.lit(False)))
    cut = cut.withColumn("g", F.sum(F.col("new").cast("int")).over(over)).groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))).alias("x"))
    cut = cut.selectExpr("path", "x[0].start + x[0].seq at", "array_join(filter(x.value, v -> v <> ''), '\n') value").where("value <> ''")
    # A sentence takes more than one byte, so that block and number in it are one order within a file.
    files = placed(pieces.select("path").distinct(), "path").selectExpr("path p", "place * 4398046511104 base")
    return inner.unionByName(cut).join(files, F.expr("path = p")).selectExpr("base + at ord", "value")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    return parse_conllu(paragraphs(with_places(spark.read.text(path))))


def parse_conllu(blocks: DataFrame) -> DataFrame:
    """(ord, original_id, rows); a sentence without an id is called s-<ord>."""
    lines = F.expr(r"filter(transform(split(value, '\n'), x -> regexp_replace(x, '\\s+$', '')), x -> x <> '')")
    out = blocks.select("ord", lines.alias("ls"))
    name = F.expr(r"try_element_at(filter(transform(ls, x -> regexp_extract(x, '^#\\s*sent_id\\s*=\\s*(\\S.*)$', 1)), x -> x <> ''), -1)")
    rows = F.expr(r"transform(filter(ls, x -> not startswith(x, '#')), x -> split(x, '\t'))")
    return out.select("ord", F.coalesce(name, F.concat(F.lit("s-"), "ord")).alias("original_id"), rows.alias("rows")).where("size(rows) > 0")


def conllu_corpus(sentences: DataFrame) -> Corpus:
    """Edges are the enhanced dependencies where given, else the basic one; root and punct edges are left out."""
    rows = sentences.select(F.col("ord").alias("sentence_id"), F.posexplode("rows").alias("position", "c"))
    at = lambda i: F.expr(f"try_element_at(c, {i + 1})")
    rows = rows.select("sentence_id", "position", *[at(i).alias(n) for i, n in enumerate(("id", "word", "lemma", "wc", "pos", "feats", "head", "deprel", "deps"))])
    tokens = rows.select("sentence_id", "position", "word", "pos", "lemma", "wc", (F.coalesce("deprel", F.lit("")) == "root").alias("root"))
    edges = F.expr(r"if(coalesce(deps, '_') <> '_', transform(split(deps, '\\|'), x -> named_struct('g', split(x, ':', 2)[0], 'r', try_element_at(split(x, ':', 2), 2))), array(named_struct('g', head, 'r', deprel)))")
    edges = rows.select("sentence_id", F.col("position").alias("dependent"), F.explode(edges).alias("e")).where("e.r not in ('root', 'punct')")
    governors = rows.select("sentence_id", F.col("id").alias("g"), F.col("position").alias("governor"))
    edges = edges.select("sentence_id", "dependent", "e.g", "e.r").join(governors, ["sentence_id", "g"])
    # No parallel edges: of several relations between two tokens, the largest.
    edges = edges.groupBy("sentence_id", "governor", "dependent").agg(F.max("r").alias("relation"))
    return build(tokens, edges)


def _incoming(corpus: Corpus) -> DataFrame:
    d = corpus.dependencies
    into = d.groupBy("sentence_id", F.col("dependent").alias("position")).agg(F.array_sort(F.collect_list(F.struct("governor", "relation"))).alias("into"))
    out = d.groupBy("sentence_id", F.col("governor").alias("position")).agg(F.array_sort(F.collect_list(F.struct("dependent", "relation"))).alias("out"))
    return corpus.tokens.join(into, ["sentence_id", "position"], "left").join(out, ["sentence_id", "position"], "left")


def to_conllu(corpus: Corpus, names: DataFrame | None = None) -> DataFrame:
    """(ord, value): CoNLL-U text of each sentence; names: (sentence_id, original_id)."""
    rows = _incoming(corpus)
    deps = F.expr("""array_join(concat(if(root, array('0:root'), array()), coalesce(transform(into, x -> concat(x.governor + 1, ':', x.relation)), array())), '|')""")
    head = F.expr("if(root, '0', coalesce(cast(into[0].governor + 1 as string), '_'))")
    rel = F.expr("if(root, 'root', coalesce(into[0].relation, '_'))")
    blank = lambda c: F.coalesce(c, F.lit("_"))
    line = F.concat_ws("\t", F.col("position") + 1, blank("word"), blank("lemma"), blank("wc"), blank("pos"), F.lit("_"), head, rel, F.when(deps == "", "_").otherwise(deps), F.lit("_"))
    text = rows.select("sentence_id", F.struct("position", line.alias("l")).alias("x")).groupBy("sentence_id").agg(F.array_sort(F.collect_list("x")).alias("ls"))
    if names is not None:
        text = text.join(names, "sentence_id")
    else:
        text = text.withColumn("original_id", F.col("sentence_id").cast("string"))
    return text.select(F.col("sentence_id").alias("ord"), F.concat(F.lit("# sent_id = "), "original_id", F.lit("\n"), F.array_join("ls.l", "\n")).alias("value"))


def write_conllu(corpus: Corpus, path: str) -> None:
    to_conllu(corpus).select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)


# ---------------------------------------------------------------- CWB


def read_cwb(spark: SparkSession, path: str, close: str = "</s>") -> DataFrame:
    return parse_cwb(read_blocks(spark, path, close))


def parse_cwb(blocks: DataFrame) -> DataFrame:
    """(ord, original_id, rows): lines of tags are left out; the id is that of <s id="..."> or <sentence id="...">."""
    name = F.regexp_extract("value", r"<s(?:entence)?\s[^>]*?\bid=([\"'])(.*?)\1", 2)
    rows = F.expr(r"transform(filter(transform(split(value, '\n'), x -> regexp_replace(x, '\r+$', '')), x -> trim(x) <> '' and not startswith(x, '<')), x -> split(x, '\t'))")
    return blocks.select("ord", F.when(name == "", F.concat(F.lit("s-"), "ord")).otherwise(name).alias("original_id"), rows.alias("rows")).where("size(rows) > 0")


def cwb_corpus(sentences: DataFrame) -> Corpus:
    """Edges are read from the incoming dependencies, relation(offset,0); punct edges and loops are left out."""
    rows = sentences.select(F.col("ord").alias("sentence_id"), F.posexplode("rows").alias("position", "c"))
    at = lambda i: F.expr(f"try_element_at(c, {i + 1})")
    tokens = rows.select("sentence_id", "position", *[at(i).alias(n) for i, n in enumerate(("word", "pos", "lemma", "wc"))], (F.trim(F.coalesce(at(6), F.lit(""))) == "root").alias("root"))
    found = F.expr(r"""filter(transform(split(c[4], '\\|'), (x, i) -> named_struct('i', i, 'r', regexp_extract(x, "^(.+)\\((-?\\d+)'*,0'*\\)$", 1), 'o', try_cast(regexp_extract(x, "^(.+)\\((-?\\d+)'*,0'*\\)$", 2) as int))), x -> x.o <> 0 and x.r <> 'punct')""")
    edges = rows.select("sentence_id", F.col("position").alias("dependent"), F.explode(found).alias("e")).withColumn("governor", F.col("dependent") + F.col("e.o"))
    edges = edges.groupBy("sentence_id", "governor", "dependent").agg(F.max_by("e.r", "e.i").alias("relation"))
    return build(tokens, edges)


def to_cwb(corpus: Corpus) -> DataFrame:
    """(sentence_id, position, columns): the seven columns of a token."""
    rows = _incoming(corpus)
    into = F.expr("concat('|', coalesce(concat(array_join(transform(into, x -> concat(x.relation, '(', x.governor - position, ',0)')), '|'), '|'), ''))")
    out = F.expr("concat('|', coalesce(concat(array_join(transform(out, x -> concat(x.relation, '(0,', x.dependent - position, ')')), '|'), '|'), ''))")
    or_x = lambda c, d: F.coalesce(F.col(c), d)
    return rows.select("sentence_id", "position", F.array("word", or_x("pos", F.lit("X")), or_x("lemma", F.col("word")), or_x("wc", F.lit("X")), into, out, F.when(F.col("root"), "root").otherwise("")).alias("columns"))


def cwb_text(corpus: Corpus) -> DataFrame:
    """(sentence_id, value): <s id=... len=...> with a line for each token."""
    lines = to_cwb(corpus).groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("position", F.array_join("columns", "\t").alias("l")))).alias("ls"))
    return lines.select("sentence_id", F.format_string('<s id="%d" len="%d">\n%s\n</s>', "sentence_id", F.size("ls"), F.array_join("ls.l", "\n")).alias("value"))


# ---------------------------------------------------------------- CoreNLP

_DEP = "array<struct<governor:int,dependent:int,dep:string>>"
CORENLP = f"sentences array<struct<index:int,tokens:array<struct<index:int,word:string,lemma:string,pos:string,originalText:string,after:string>>,basicDependencies:{_DEP},enhancedPlusPlusDependencies:{_DEP}>>"


def read_corenlp_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, original_id, text, rows): CoNLL-U rows of CoreNLP's JSON."""
    s = spark.read.schema(CORENLP).json(path, multiLine=True).select(F.monotonically_increasing_id().alias("doc"), F.explode("sentences").alias("s"))
    s = s.select((F.col("doc") * 1_000_000 + F.col("s.index")).alias("ord"), F.col("s.index").cast("string").alias("original_id"), "s.*")
    text = F.expr("rtrim(array_join(transform(array_sort(tokens, (x, y) -> x.index - y.index), t -> concat(t.originalText, t.after)), ''))")
    s = s.withColumn("text", text).withColumn("basic", F.expr("map_from_entries(transform(basicDependencies, d -> struct(d.dependent, d)))")).withColumn("tag", F.expr("map_from_entries(transform(tokens, t -> struct(t.index, t.pos)))"))
    t = s.select("ord", "original_id", "text", "basic", "tag", F.col("enhancedPlusPlusDependencies").alias("epp"), F.explode("tokens").alias("t"))
    form = tags.brackets(F.col("t.word"))
    lemma = F.when(F.col("t.word").isin(list(tags.BRACKETS)), form).otherwise(F.col("t.lemma"))
    base = F.expr("try_element_at(basic, t.index)")
    rel = F.when(base["dep"] == "ROOT", "root").otherwise(base["dep"])
    deps = F.expr("""array_join(transform(array_sort(array_distinct(transform(filter(epp, d -> d.dependent = t.index and d.governor <> t.index),
        d -> struct(d.governor g, replace(if(d.dep = 'ROOT', 'root', d.dep), '|', '-pipe-') r)))), x -> concat(x.g, ':', x.r)), '|')""")
    t = t.withColumn("head", base["governor"]).withColumn("rel", rel).withColumn("gov", F.expr("try_element_at(tag, head)"))
    row = F.array(F.col("t.index").cast("string"), form, lemma, tags.upos(lemma, F.col("t.pos"), F.col("rel"), F.col("gov")), F.col("t.pos"), F.lit("_"), F.col("head").cast("string"), F.col("rel"), deps, F.lit("_"))
    t = t.select("ord", "original_id", "text", F.struct(F.col("t.index").alias("i"), row.alias("row")).alias("x"))
    return t.groupBy("ord", "original_id", "text").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("ord", "original_id", "text", F.col("xs.row").alias("rows"))


def write_corenlp_conllu(sentences: DataFrame, path: str) -> None:
    head = F.concat(F.lit("# sent_id = "), "original_id", F.lit("\n# text = "), "text", F.lit("\n"))
    body = F.expr("array_join(transform(rows, r -> array_join(r, '\t')), '\n')")
    sentences.select(F.concat(head, body, F.lit("\n")).alias("value")).write.text(path)


_XML_END = "struct<_VALUE:string,_idx:int,_copy:int>"
CORENLP_XML = f"_id string, tokens struct<token:array<struct<_id:int,word:string,lemma:string,POS:string>>>, dependencies array<struct<_type:string,dep:array<struct<_type:string,governor:{_XML_END},dependent:{_XML_END}>>>>"


def read_corenlp_xml(spark: SparkSession, path: str) -> DataFrame:
    """(ord, original_id, rows): CWB rows of CoreNLP's XML, from the enhanced++ dependencies."""
    s = spark.read.format("xml").option("rowTag", "sentence").schema(CORENLP_XML).load(path)
    s = s.select(F.monotonically_increasing_id().alias("ord"), F.col("_id").alias("original_id"), "tokens.token", F.expr("flatten(transform(filter(dependencies, d -> d._type = 'enhanced-plus-plus-dependencies'), d -> d.dep)) deps"))
    t = s.select("ord", "original_id", "deps", F.explode("token").alias("t"))
    primes = lambda end: f"""repeat("'", coalesce(x.{end}._copy, 0))"""
    into = F.expr(f"""transform(filter(deps, x -> x.dependent._idx = t._id and x.governor._idx > 0), x -> concat(x._type, '(', x.governor._idx - t._id, {primes('governor')}, ',0', {primes('dependent')}, ')'))""")
    out = F.expr(f"""transform(filter(deps, x -> x.governor._idx = t._id), x -> concat(x._type, '(0', {primes('governor')}, ',', x.dependent._idx - t._id, {primes('dependent')}, ')'))""")
    bar = lambda xs: F.concat(F.lit("|"), F.when(F.size(xs) > 0, F.concat(F.array_join(xs, "|"), F.lit("|"))).otherwise(""))
    root = F.expr("if(exists(deps, x -> x.dependent._idx = t._id and x.governor._idx = 0), 'root', '')")
    row = F.array(F.col("t.word"), F.col("t.POS"), F.col("t.lemma"), tags.word_class(F.col("t.POS")), bar(into), bar(out), root)
    t = t.select("ord", "original_id", F.struct(F.col("t._id").alias("i"), row.alias("row")).alias("x"))
    return t.groupBy("ord", "original_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("ord", "original_id", F.col("xs.row").alias("rows"))


# ---------------------------------------------------------------- JSON, DOT, chemical, adjacency

GRAPH = "directed boolean, links array<struct<relation:string,source:int,target:int>>, multigraph boolean, nodes array<struct<id:int,lemma:string,pos:string,root:string,wc:string,word:string>>"


def to_json(corpus: Corpus) -> DataFrame:
    """(sentence_id, graph): node-link JSON with sorted keys."""
    nodes = F.expr("transform(tokens, t -> named_struct('id', t.position, 'lemma', t.lemma, 'pos', t.pos, 'root', if(t.root, 'root', null), 'wc', t.wc, 'word', t.word))")
    links = F.expr("transform(dependencies, d -> named_struct('relation', d.relation, 'source', d.governor, 'target', d.dependent))")
    return corpus.graphs().select("sentence_id", F.to_json(F.struct(F.lit(True).alias("directed"), links.alias("links"), F.lit(False).alias("multigraph"), nodes.alias("nodes"))).alias("graph"))


def from_json(rows: DataFrame) -> Corpus:
    g = rows.select("sentence_id", F.from_json("graph", GRAPH).alias("g"))
    tokens = g.select("sentence_id", F.explode("g.nodes").alias("n")).select("sentence_id", F.col("n.id").alias("position"), "n.word", "n.pos", "n.lemma", "n.wc", (F.coalesce("n.root", F.lit("")) == "root").alias("root"))
    deps = g.select("sentence_id", F.explode("g.links").alias("l")).select("sentence_id", F.col("l.source").alias("governor"), F.col("l.target").alias("dependent"), "l.relation")
    return build(tokens, deps)


def to_dot(corpus: Corpus) -> DataFrame:
    """(sentence_id, value): a drawing of each sentence in the DOT language."""
    q = lambda x: f"""replace(replace(coalesce({x}, ''), '\\\\', '\\\\\\\\'), '"', '\\\\"')"""
    nodes = F.expr(f"""transform(tokens, t -> concat('  ', t.position, ' [label="', {q('t.word')}, '"];'))""")
    links = F.expr(f"""transform(dependencies, d -> concat('  ', d.governor, ' -> ', d.dependent, ' [label="', {q('d.relation')}, '"];'))""")
    return corpus.graphs().select("sentence_id", F.concat(F.lit("digraph {\n"), F.array_join(F.concat(nodes, links), "\n"), F.lit("\n}")).alias("value"))


def to_chemical(corpus: Corpus) -> DataFrame:
    """(sentence_id, value): a t line, v lines (vertex, label id) and e lines (source, target, label id); ids from 1 by label order."""
    label = F.struct("word", F.coalesce("pos", F.lit("X")).alias("pos"), F.coalesce("lemma", "word").alias("lemma"), F.coalesce("wc", F.lit("X")).alias("wc"))
    t = corpus.tokens.select("sentence_id", "position", label.alias("label"))
    ids = placed(t.select("label").distinct(), "label").select("label", (F.col("place") + 1).alias("id"))
    kinds = placed(corpus.dependencies.select("relation").distinct(), "relation").select("relation", (F.col("place") + 1).alias("id"))
    v = t.join(ids, "label").select("sentence_id", F.struct(F.lit(0).alias("k"), F.col("position").alias("a"), F.lit(0).alias("b"), F.format_string("v %d %d", "position", "id").alias("l")).alias("x"))
    e = corpus.dependencies.join(kinds, "relation").select("sentence_id", F.struct(F.lit(1).alias("k"), F.col("governor").alias("a"), F.col("dependent").alias("b"), F.format_string("e %d %d %d", "governor", "dependent", "id").alias("l")).alias("x"))
    rows = v.unionAll(e).groupBy("sentence_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("sentence_id", F.concat(F.lit("t # \n"), F.array_join("xs.l", "\n")).alias("value"))


def to_adjacency(corpus: Corpus) -> DataFrame:
    """(sentence_id, matrix): labels on the diagonal, relations elsewhere, empty maps where there is no edge."""
    cell = """case when i.position = j.position then map_filter(map('word', i.word, 'pos', i.pos, 'lemma', i.lemma, 'wc', i.wc, 'root', if(i.root, 'root', null)), (k, v) -> v is not null)
        else coalesce(try_element_at(transform(filter(dependencies, d -> d.governor = i.position and d.dependent = j.position), d -> map('relation', d.relation)), 1), cast(map() as map<string, string>)) end"""
    return corpus.graphs().select("sentence_id", F.expr(f"transform(tokens, i -> transform(tokens, j -> {cell})) matrix"))


def from_adjacency(rows: DataFrame) -> Corpus:
    cells = rows.select("sentence_id", F.posexplode("matrix").alias("i", "row")).select("sentence_id", "i", F.posexplode("row").alias("j", "m")).where("size(m) > 0")
    get = lambda k: F.expr(f"try_element_at(m, '{k}')")
    tokens = rows.select("sentence_id", F.posexplode("matrix").alias("position", "row")).select("sentence_id", "position", F.expr("row[position]").alias("m"))
    tokens = tokens.select("sentence_id", "position", *[get(k).alias(k) for k in ("word", "pos", "lemma", "wc")], (F.coalesce(get("root"), F.lit("")) == "root").alias("root"))
    deps = cells.where("i <> j").select("sentence_id", F.col("i").alias("governor"), F.col("j").alias("dependent"), get("relation").alias("relation"))
    # Vertices keep their numbers, unconnected ones too.
    return Corpus(with_degrees(tokens, deps).select(*[f.split()[0] for f in TOKENS.split(", ")]), deps)


def to_edge_list(corpus: Corpus) -> DataFrame:
    """(sentence_id, edges): a JSON list of [governor, dependent, relation] in order."""
    edge = F.expr("array_join(transform(dependencies, d -> concat('[', d.governor, ', ', d.dependent, ', ', substring(to_json(array(d.relation)), 2))), ', ')")
    return corpus.graphs().select("sentence_id", F.concat(F.lit("["), edge, F.lit("]")).alias("edges"))


def from_edge_list(rows: DataFrame) -> DataFrame:
    """(sentence_id, governor, dependent, relation)."""
    e = rows.select("sentence_id", F.explode(F.from_json("edges", "array<array<string>>")).alias("e"))
    return e.selectExpr("sentence_id", "cast(e[0] as int) governor", "cast(e[1] as int) dependent", "e[2] relation")




# ---------------------------------------------------------------- results


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def insert_ignore(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a Parquet table the rows whose keys it doesn't have yet; of equal keys, one."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(keys)
    try:
        held = spark.read.parquet(path).select(*keys)
        new = new.alias("l").join(held.alias("r"), F.expr(" and ".join(f"l.{k} <=> r.{k}" for k in keys)), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)
