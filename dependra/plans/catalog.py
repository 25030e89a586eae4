"""The queries of the engine over the derived treebank, and SQL that says the same independently."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from dependra.functions import tags
from dependra.functions.measures import MEASURES, Table, rounded
from dependra.operators import collexemes as col
from dependra.operators import counting as cnt
from dependra.operators import graphs, match, structures
from dependra.plans import compiler
from dependra.plans.pattern import MARKS, Pattern, parse, skeletize, split_association, to_adjacency
from dependra.sources import formats
from dependra.sources.corpus import Corpus
from dependra.sources.treebank import treebank

# ---------------------------------------------------------------- SQL of the treebank

_ITEMS = """items as materialized (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as int) pos0
  from lineitem join part on l_partkey = p_partkey),
base as (select l_orderkey::bigint sentence_id, pos0 as position, p_name || '/' || l_linestatus as word, l_linestatus as pos, p_name as lemma,
  case l_returnflag when 'R' then 'VERB' when 'A' then 'NOUN' when 'N' then 'ADJ' end as wc, pos0 = 0 as root from items),
d as materialized (select l_orderkey::bigint sentence_id, ((pos0 - 1) // 2)::int governor, pos0 dependent, ['obj','iobj','obl','det','nmod','amod'][(p_size % 6 + 1)::int] relation from items where pos0 > 0 RAW
  union all select l_orderkey::bigint, pos0 - 2, pos0, 'conj' from items where pos0 >= 5 and pos0 % 2 = 1 and l_quantity >= 40 RAW)"""
TREE = "with recursive " + _ITEMS.replace("RAW", "") + """,
t as materialized (select base.*, (select count(*) from d where d.sentence_id = base.sentence_id and dependent = position)::int indegree, (select count(*) from d where d.sentence_id = base.sentence_id and governor = position)::int outdegree from base)
"""
RAW = "with recursive " + _ITEMS.replace("d as materialized (", "d0 as materialized (").replace("RAW", "and l_tax < 0.08") + """,
kept as materialized (select *, cast(row_number() over (partition by sentence_id order by position) - 1 as int) nr from base where root or exists (select 1 from d0 where d0.sentence_id = base.sentence_id and (governor = position or dependent = position))),
d as materialized (select d0.sentence_id, g.nr governor, h.nr dependent, relation from d0 join kept g on g.sentence_id = d0.sentence_id and g.position = governor join kept h on h.sentence_id = d0.sentence_id and h.position = dependent),
t as materialized (select sentence_id, nr as position, word, pos, lemma, wc, root, (select count(*) from d where d.sentence_id = kept.sentence_id and dependent = nr)::int indegree, (select count(*) from d where d.sentence_id = kept.sentence_id and governor = nr)::int outdegree from kept)
"""

_R = 6


def _log(x: str) -> str:
    return f"case when {x} > 0 then log2({x}) end"


def _ratio(a: str, b: str) -> str:
    return f"case when ({b}) <> 0 then ({a}) / ({b}) end"


_CELLS = """select *, r1 - o11 o12, c1 - o11 o21, n - r1 - c1 + o11 o22, n - r1 r2, n - c1 c2, r1 * c1 / nullif(n, 0) e11, r1 * (n - c1) / nullif(n, 0) e12, (n - r1) * c1 / nullif(n, 0) e21, (n - r1) * (n - c1) / nullif(n, 0) e22"""
_LL = "2 * (" + " + ".join(f"case when {o} = 0 then 0 when {o} > 0 and {e} > 0 then {o} * log2({o} / {e}) end" for o, e in (("o11", "e11"), ("o12", "e12"), ("o21", "e21"), ("o22", "e22"))) + ")"
_CHI = _ratio("(o11 + o12 + o21 + o22) * (o11 - e11) * (o11 - e11)", "e11 * e22")
_DET = "o11 * o22 - o12 * o21"
MEASURE_SQL = {
    "poisson_stirling_log": f"o11 * ({_log('o11')} - {_log('e11')} - 1)",
    "z_score": "case when e11 > 0 then (o11 - e11) / sqrt(e11) end",
    "t_score": "case when o11 > 0 then (o11 - e11) / sqrt(o11) end",
    "chi_squared": _CHI,
    "one_sided_chi_squared": f"case when o11 < e11 then -1 else 1 end * {_CHI}",
    "log_likelihood": _LL,
    "one_sided_log_likelihood": f"case when o11 < e11 then -1 else 1 end * {_LL}",
    "mutual_information": "case when o11 > 0 and e11 > 0 then log2(o11 / e11) end",
    "local_mi": "case when o11 > 0 and e11 > 0 then o11 * log2(o11 / e11) end",
    "average_mi": _LL,
    "mi2": "case when o11 > 0 and e11 > 0 then log2(o11 * o11 / e11) end",
    "mi3": "case when o11 > 0 and e11 > 0 then log2(o11 * o11 * o11 / e11) end",
    "odds_ratio_disc": "case when (o12 + 0.5) * (o21 + 0.5) <> 0 and (o11 + 0.5) * (o22 + 0.5) / ((o12 + 0.5) * (o21 + 0.5)) > 0 then log2((o11 + 0.5) * (o22 + 0.5) / ((o12 + 0.5) * (o21 + 0.5))) end",
    "relative_risk": "case when o12 * (o11 + o21) <> 0 and o11 * (o12 + o22) / (o12 * (o11 + o21)) > 0 then log2(o11 * (o12 + o22) / (o12 * (o11 + o21))) end",
    "liddell": _ratio(_DET, "c1 * c2"),
    "minimum_sensitivity": "case when r1 <> 0 and c1 <> 0 then least(o11 / r1, o11 / c1) end",
    "geometric_mean": "case when r1 * c1 > 0 then o11 / sqrt(r1 * c1) end",
    "dice": _ratio("2 * o11", "r1 + c1"),
    "jaccard": _ratio("o11", "o11 + o12 + o21"),
    "cooccurrence_frequency": "o11",
    "delta_p_column": _ratio(_DET, "c1 * c2"),
    "delta_p_row": _ratio(_DET, "r1 * r2"),
    "max_delta_p": f"case when c1 * c2 <> 0 and r1 * r2 <> 0 then greatest(({_DET}) / (c1 * c2), ({_DET}) / (r1 * r2)) end",
}


def _measured(rows: str, keys: str, extra: str = "") -> str:
    """SQL: keys, the frequencies and the three usual measures of a table with doubles o11, r1, c1, n."""
    ll, ts, di = (f"round({MEASURE_SQL[m]}, {_R}) + 0::double" for m in ("one_sided_log_likelihood", "t_score", "dice"))
    return f"select {keys}, o11::bigint o11, R1 r1, C1 c1, n::bigint n{extra}, {ll} log_likelihood, {ts} t_score, {di} dice from ({_CELLS} from ({rows}))"


# ---------------------------------------------------------------- patterns

VERB, NOUN, ADJ = {"wc": "VERB"}, {"wc": "NOUN"}, {"wc": "ADJ"}
OBJ = Pattern((VERB, NOUN), ((0, 1, {"relation": "obj"}),))
PATH = Pattern((VERB, {}, NOUN), ((0, 1, {}), (1, 2, {"not_relation": "det"})))
TWO_AMOD = Pattern(({}, {}, {}), ((0, 1, {"relation": "amod"}), (0, 2, {"relation": "amod"})))
NEGATED = Pattern(({"wc": "VERB", "not_outdep": ["iobj", "obl"]}, {"not_wc": "VERB", "not_indep": ["conj"]}), ((0, 1, {"relation": "obj"}),))
SHAPE = Pattern(({}, {}, {}), ((0, 1, {}), (1, 2, {})))

#: VERB -amod-> x; A adds a dependent that isn't conj, B any other dependent.
INCONSISTENT = parse({
    "nodes": [{"id": 0, "query": "AB", "wc": "VERB"}, {"id": 1, "query": "AB"}, {"id": 2, "query": "A"}, {"id": 3, "query": "B"}],
    "links": [{"source": 0, "target": 1, "relation": "amod"}, {"source": 0, "target": 2, "not_relation": "conj"}, {"source": 0, "target": 3}],
})
#: A: the verb is finished (pos F); B: an object that is a noun.
ASSOCIATION = parse({
    "nodes": [{"id": 0, "query": "AB", "wc": "VERB", "pos": "F", "only_A": ["pos"]}, {"id": 1, "query": "B", "wc": "NOUN"}],
    "links": [{"source": 0, "target": 1, "relation": "obj"}],
})
#: Two amod dependents; A: one of them has an object, B: one of them has a nmod; both may be the same one or not.
BRANCHED = parse({
    "nodes": [{"id": 0, "query": "AB"}, {"id": 1, "query": "AB"}, {"id": 2, "query": "AB"}, {"id": 3, "query": "A"}, {"id": 4, "query": "B"}],
    "links": [{"source": 0, "target": 1, "relation": "amod"}, {"source": 0, "target": 2, "relation": "amod"}, {"source": 1, "target": 3, "relation": "obj"}, {"source": 1, "target": 4, "relation": "nmod"}],
})
COLLEXEME = Pattern((VERB | {"collo_item": True}, {}), ((0, 1, {"relation": "obj"}),))
COVARYING = Pattern((VERB | {"collo_A": True}, {"collo_B": True}), ((0, 1, {"relation": "amod"}),))
SYMMETRIC = Pattern(({"focus_point": True}, {"collo_A": True}, {"collo_B": True}), ((0, 1, {"relation": "amod"}), (0, 2, {"relation": "amod"})))


def _bank(f):
    return lambda spark, sf_dir: f(treebank(spark, sf_dir))


def _lemma(corpus) -> str:
    """The most frequent lemma, the first of equal ones."""
    return corpus.tokens.groupBy("lemma").count().orderBy(F.desc("count"), "lemma").first()[0]


def _larger(corpus):
    return structures.larger_structures(corpus, Pattern((VERB | {"lemma": _lemma(corpus)},), ()), max_size=3, min_coocc=2, digits=_R)


def _signature(key: str, center: str, wc: str = "''") -> str:
    """SQL of a text that names a structure around one vertex as DuckDB can make it too: the other vertices by their labels and edges to
    that vertex, sorted, then the edges among them."""
    links, nodes = f"from_json({key}, '{_LINKS}').links", f"from_json({key}, '{_LINKS}').nodes"
    kind = f"array_join(transform(filter({nodes}, x -> x.id = V), x -> {wc}), '')"
    own = f"filter({links}, e -> (e.source = {center} and e.target = V) or (e.target = {center} and e.source = V))"
    label = f"concat({kind}, array_join(array_sort(transform({own}, e -> concat(if(e.source = {center}, 'o:', 'i:'), coalesce(e.relation, '')))), '+'))"
    others = f"array_except(transform({nodes}, x -> x.id), array({center}))"
    side = f"transform(filter({links}, f -> f.source <> {center} and f.target <> {center}), f -> concat({label.replace('V', 'f.source')}, '>', {label.replace('V', 'f.target')}, '=', coalesce(f.relation, '')))"
    return f"concat(array_join(array_sort(transform({others}, v -> {label.replace('V', 'v')})), ';'), '|', array_join(array_sort({side}), ';'))"


_LINKS = "nodes array<struct<id:int,wc:string,query:string>>, links array<struct<source:int,target:int,relation:string>>"


def _stars(corpus, kind: str):
    rows = structures.star_frequencies(structures.star_rows(corpus), skeleton=kind == "skeleton", labels=kind == "edge")
    keep = ["length", "degrees", *(["relations", "pos", "wc"] if kind == "edge" else []), "star_freq", "center_freq"]
    return rows.select(F.expr(_signature(f"{kind}_key", f"{kind}_center")).alias("star"), *keep)


def _edge_to_skeleton(corpus):
    rows = structures.edge_to_skeleton(structures.star_rows(corpus))
    return rows.selectExpr(f"{_signature('edge_key', 'edge_center')} star", f"array_join(array_sort(transform(skeletons, k -> {_signature('k.skeleton_key', 'k.skeleton_center')})), ' ') skeletons")


def _larger_signatures(corpus):
    rows = _larger(corpus).withColumn("m", F.expr(f"filter(from_json(larger_structure, '{_LINKS}').nodes, x -> x.query = 'A')[0].id"))
    return rows.withColumn("larger_structure", F.expr(_signature("larger_structure", "m", "concat(x.wc, ':')"))).drop("m")


def _reach(spark, sf_dir):
    return graphs.reachable(treebank(spark, sf_dir, raw=True))


# Embeddings of the first pattern for the neighbourhoods.
def _near(corpus):
    sets = compiler.embeddings(corpus, OBJ).select("sentence_id", F.expr("array_sort(array(m0, m1))").alias("vs")).distinct()
    out = graphs.neighbourhood(corpus, sets, "vs")
    return out.selectExpr("sentence_id", "array_join(vs, ' ') vertices", "array_join(neighbourhood, ' ') neighbourhood")


def _measure_query(name):
    def run(spark, sf_dir):
        rows = col.collexemes(treebank(spark, sf_dir), COLLEXEME).select("lemma", "o11", "r1", "c1", "n")
        return rows.select("lemma", rounded(MEASURES[name](Table()), _R).alias(name))

    return run


def _flat(df):
    return df.selectExpr("sentence_id", "array_join(transform(vertices, x -> cast(x as string)), ' ') vertices", "array_join(transform(edges, e -> concat(e.g, '>', e.d)), ' ') edges")


_COLLEX_ROWS = """select lemma, o11::double o11, (sum(o11) over ())::double r1, c1::double c1, n::double n from
  (select x.lemma, count(*) o11 from (select distinct d.sentence_id, governor from d join t on t.sentence_id = d.sentence_id and position = governor where wc = 'VERB' and relation = 'obj') e join t x on x.sentence_id = e.sentence_id and x.position = e.governor group by x.lemma) o
  join (select lemma, count(*) c1 from t where wc = 'VERB' group by lemma) c using (lemma), (select count(*) n from t where wc = 'VERB')"""

_INC_FLAGS = """g as (select d.sentence_id, governor m0, dependent m1 from d join t on t.sentence_id = d.sentence_id and t.position = governor where wc = 'VERB' and relation = 'amod'),
f as (select *, exists (select 1 from d where d.sentence_id = g.sentence_id and governor = m0 and relation <> 'conj' and dependent <> m1) fa,
  exists (select 1 from d where d.sentence_id = g.sentence_id and governor = m0 and dependent <> m1) fb,
  exists (select 1 from d x join d y on x.sentence_id = y.sentence_id and x.governor = y.governor where x.sentence_id = g.sentence_id and x.governor = m0 and x.relation <> 'conj' and x.dependent <> m1 and y.dependent <> m1 and x.dependent <> y.dependent) fc from g)"""
_ASS_FLAGS = """g as (select sentence_id, position m0, pos from t where wc = 'VERB'),
f as (select sentence_id, m0, m0 m1, pos = 'F' fa, b fb, b and pos = 'F' fc from (select *, exists (select 1 from d join t x on x.sentence_id = d.sentence_id and x.position = dependent where d.sentence_id = g.sentence_id and governor = m0 and relation = 'obj' and x.wc = 'NOUN') b from g))"""
_UNITS = """u as (select method, sentence_id, unit, max(fa::int) fa, max(fb::int) fb, max(fc::int) fc from (
  select 'embeddings' as method, sentence_id, m0::varchar || ',' || m1::varchar unit, fa, fb, fc from f union all
  select 'subgraphs', sentence_id, least(m0, m1)::varchar || ',' || greatest(m0, m1)::varchar, fa, fb, fc from f union all
  select 'focus_points', sentence_id, m0::varchar, fa, fb, fc from f union all select 'sentences', sentence_id, '', fa, fb, fc from f) group by all),
s as (select method, sum(fc)::double o11, sum(fa) - sum(fa * fb * (1 - fc)) / 2 r1, sum(fb) - sum(fa * fb * (1 - fc)) / 2 c1, count(*)::double n, sum(fa * fb * (1 - fc))::bigint inconsistent from u group by method)"""


def _association_sql(flags: str) -> str:
    return f"{TREE}, {flags}, {_UNITS} " + _measured("select * from s", "method", ", inconsistent").replace("R1 r1", "r1::double r1").replace("C1 c1", "c1::double c1")


def _covarying_sql(rows: str, sub: str, focus: str) -> str:
    """rows: item_a, item_b, e (embedding), sub, focus per embedding; its units by method, then pairs, marginals and lacking pairs."""
    return f"""{TREE}, e as ({rows}),
u as (select 'embeddings' as method, sentence_id, emb unit, item_a, item_b from e union all select 'subgraphs', sentence_id, {sub}, item_a, item_b from e
  union all select 'focus_points', sentence_id, {focus}, item_a, item_b from e union all select 'sentences', sentence_id, '', item_a, item_b from e),
p as (select distinct * from u),
k as (select method, item_a, item_b, count(*) o11 from (select * from u where method = 'embeddings' union all select * from p where method <> 'embeddings') group by all),
l as (select a.method, a.item_a, b.item_b, count(*) inconsistent from (select distinct method, sentence_id, unit, item_a from p where method <> 'embeddings') a
  join (select distinct method, sentence_id, unit, item_b from p) b on a.method = b.method and a.sentence_id = b.sentence_id and a.unit = b.unit
  where not exists (select 1 from p where p.method = a.method and p.sentence_id = a.sentence_id and p.unit = a.unit and p.item_a = a.item_a and p.item_b = b.item_b) group by all),
z as (select method, count(distinct (sentence_id, unit)) n from u group by method),
r as (select k.item_a, k.item_b, k.method, o11::double o11, (sum(o11) over (partition by k.method, k.item_a))::double - coalesce(inconsistent, 0) / 2 r1,
  (sum(o11) over (partition by k.method, k.item_b))::double - coalesce(inconsistent, 0) / 2 c1, n::double n, coalesce(inconsistent, 0)::bigint inconsistent
  from k left join l on k.method = l.method and k.item_a = l.item_a and k.item_b = l.item_b join z on k.method = z.method)
""" + _measured("select * from r", "item_a, item_b, method", ", inconsistent").replace("R1 r1", "r1").replace("C1 c1", "c1")


def _legacy_sql(flags: str, unit: str, name: str) -> str:
    return f"""{TREE}, {flags}, u as (select {unit} unit, sentence_id, max(fa::int) fa, max(fb::int) fb, max(fc::int) fc from f group by all)
select '{name}' as method, sum(fc)::bigint o11, sum(fa) - sum(fa * fb * (1 - fc)) / 2 r1, sum(fb) - sum(fa * fb * (1 - fc)) / 2 c1, count(*) n, sum(fa * fb * (1 - fc))::bigint inconsistent from u"""


# For the association pattern a focus point's flags don't depend on what lies outside, so that legacy and current flags agree.
_SENT_FLAGS = """f as (select sentence_id, exists (select 1 from t x where x.sentence_id = q.sentence_id and wc = 'VERB' and pos = 'F') fa,
  exists (select 1 from t x join d on d.sentence_id = x.sentence_id and governor = x.position join t y on y.sentence_id = x.sentence_id and y.position = dependent where x.sentence_id = q.sentence_id and x.wc = 'VERB' and relation = 'obj' and y.wc = 'NOUN') fb,
  exists (select 1 from t x join d on d.sentence_id = x.sentence_id and governor = x.position join t y on y.sentence_id = x.sentence_id and y.position = dependent where x.sentence_id = q.sentence_id and x.wc = 'VERB' and x.pos = 'F' and relation = 'obj' and y.wc = 'NOUN') fc
  from (select distinct sentence_id from t where wc = 'VERB') q)"""

# A unit is a governor and two of its amod dependents, whichever part each plays; A and B name others than those three.
_BRANCHED_FLAGS = """g as (select x.sentence_id, x.governor m0, x.dependent a, y.dependent b from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor and x.dependent < y.dependent where x.relation = 'amod' and y.relation = 'amod'),
z as (select g.sentence_id, m0, a, b, z.governor p, z.dependent q, z.relation r from g join d z on z.sentence_id = g.sentence_id and z.governor in (a, b) where z.dependent not in (m0, a, b)),
f as (select sentence_id, m0, a, b, exists (select 1 from z where z.sentence_id = g.sentence_id and z.m0 = g.m0 and z.a = g.a and z.b = g.b and r = 'obj') fa,
  exists (select 1 from z where z.sentence_id = g.sentence_id and z.m0 = g.m0 and z.a = g.a and z.b = g.b and r = 'nmod') fb,
  exists (select 1 from z join z y on y.sentence_id = z.sentence_id and y.m0 = z.m0 and y.a = z.a and y.b = z.b and y.p = z.p where z.sentence_id = g.sentence_id and z.m0 = g.m0 and z.a = g.a and z.b = g.b and z.r = 'obj' and y.r = 'nmod') fc from g)"""

_TAGGED = """b as (select p_partkey::bigint id, (['CC','CD','NN','VBZ','TO','IN','DT','WDT','RB','NFP','EX','JJ','ZZ'])[(p_partkey % 13 + 1)::int] tag,
  (['that','not','%','--','someone','x'])[(p_partkey // 13 % 6 + 1)::int] lemma, (['mark','det','aux','obj'])[(p_size % 4 + 1)::int] rel, case when p_size % 3 = 0 then 'VB' else 'NN' end gov from part)"""


def _tagged(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "cast(p_partkey as long) id", "element_at(array('CC','CD','NN','VBZ','TO','IN','DT','WDT','RB','NFP','EX','JJ','ZZ'), cast(p_partkey % 13 + 1 as int)) tag",
        "element_at(array('that','not','%','--','someone','x'), cast(p_partkey div 13 % 6 + 1 as int)) lemma", "element_at(array('mark','det','aux','obj'), cast(p_size % 4 + 1 as int)) rel",
        "if(p_size % 3 = 0, 'VB', 'NN') gov")


def _files(spark, write) -> str:
    """A new folder that write(path) has filled: in the shared one of spark.checkpoint.dir, where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{base.rstrip('/')}/text-{uuid.uuid4().hex}" if base else f"{tempfile.mkdtemp(prefix='dependra-')}/text"
    write(path)
    return path


def _conllu_lines(spark, sf_dir):
    """The treebank written as CoNLL-U with comments, CRLF after every third sentence and separators of several kinds, and read from the files."""
    text = formats.to_conllu(treebank(spark, sf_dir))
    odd = """case ord % 3 when 0 then concat(replace(replace(value, '# sent_id = ', '#sent_id='), '\n', '\r\n'), '\r\n\t \r')
        when 1 then concat('# text = x\n', value, '\n  ') else concat(value, '\n\n') end"""
    path = _files(spark, lambda p: text.selectExpr(odd).write.text(p))
    return _with_names(formats.read_conllu(spark, path), formats.conllu_corpus).dependencies


_PENN = "element_at(map('VERB', 'VBZ', 'NOUN', 'NN', 'ADJ', 'JJ'), wc)"


def _corenlp_json(spark, sf_dir):
    """The treebank as documents of CoreNLP's JSON, eight of them, converted to CoNLL-U rows."""
    bank = treebank(spark, sf_dir)
    tokens = bank.tokens.selectExpr("sentence_id", "root", f"named_struct('index', position + 1, 'word', word, 'lemma', lemma, 'pos', {_PENN}, 'originalText', word, 'after', ' ') t")
    tokens = tokens.groupBy("sentence_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"), F.expr("max(if(root, t.index, null))").alias("root"))
    deps = bank.dependencies.selectExpr("sentence_id", "named_struct('governor', governor + 1, 'dependent', dependent + 1, 'dep', relation) d").groupBy("sentence_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    every = "concat(array(named_struct('governor', 0, 'dependent', root, 'dep', 'ROOT')), coalesce(ds, array()))"
    one = tokens.join(deps, "sentence_id", "left").selectExpr("sentence_id % 8 k", f"named_struct('index', cast(sentence_id as int), 'tokens', tokens, 'basicDependencies', filter({every}, d -> d.dep <> 'conj'), 'enhancedPlusPlusDependencies', {every}) s")
    docs = one.groupBy("k").agg(F.to_json(F.struct(F.collect_list("s").alias("sentences"))).alias("value"))
    path = _files(spark, lambda p: docs.select("value").write.option("maxRecordsPerFile", 1).text(p))
    return formats.read_corenlp_json(spark, path).selectExpr("cast(original_id as long) sentence_id", "text", "explode(rows) r").selectExpr("sentence_id", "text", "array_join(r, '\t') line")


def _corenlp_xml(spark, sf_dir):
    """The treebank as CoreNLP's XML, converted to CWB rows."""
    bank = treebank(spark, sf_dir)
    tokens = bank.tokens.selectExpr("sentence_id", "position", "root", f"concat('<token id=\"', position + 1, '\"><word>', word, '</word><lemma>', lemma, '</lemma><POS>', {_PENN}, '</POS></token>') x")
    tokens = tokens.groupBy("sentence_id").agg(F.expr("array_join(array_sort(collect_list(struct(position, x))).x, '')").alias("ts"), F.expr("max(if(root, position + 1, null))").alias("root"))
    dep = "concat('<dep type=\"', relation, '\"><governor idx=\"', governor + 1, '\">x</governor><dependent idx=\"', dependent + 1, '\">x</dependent></dep>')"
    deps = bank.dependencies.selectExpr("sentence_id", "governor", "dependent", f"{dep} x").groupBy("sentence_id").agg(F.expr("array_join(array_sort(collect_list(struct(governor, dependent, x))).x, '')").alias("ds"))
    text = """concat('<sentence id="', sentence_id, '"><tokens>', ts, '</tokens><dependencies type="basic-dependencies"></dependencies><dependencies type="enhanced-plus-plus-dependencies"><dep type="root"><governor idx="0">ROOT</governor><dependent idx="', root, '">x</dependent></dep>', coalesce(ds, ''), '</dependencies></sentence>')"""
    rows = tokens.join(deps, "sentence_id", "left").selectExpr("sentence_id % 8 k", f"{text} s").groupBy("k").agg(F.expr("concat('<root><document><sentences>', array_join(collect_list(s), '\n'), '</sentences></document></root>')").alias("value"))
    path = _files(spark, lambda p: rows.select("value").write.option("maxRecordsPerFile", 1).text(p))
    return formats.read_corenlp_xml(spark, path).selectExpr("cast(original_id as long) sentence_id", "posexplode(rows) as (position, r)").selectExpr("sentence_id", "position", "array_join(r, '\t') line")


def _association_tsv(spark, sf_dir):
    """The association as the tool writes it, read back from the file."""
    rows = col.wide(cnt.association(treebank(spark, sf_dir), split_association(ASSOCIATION), _R).withColumn("query_number", F.lit(1)), ["query_number"])
    path = _files(spark, lambda p: formats.write_tsv(rows, p))
    return spark.read.schema(rows.schema).csv(path, sep="\t", header=True)


def _stored(spark, sf_dir):
    """The treebank written as a database and opened again."""
    bank = treebank(spark, sf_dir)
    return Corpus.read(spark, _files(spark, bank.write))


def _gzipped(spark, sf_dir):
    text = formats.to_conllu(treebank(spark, sf_dir)).selectExpr("concat(value, '\n') value")
    path = _files(spark, lambda p: text.write.option("compression", "gzip").text(p))
    return _with_names(formats.read_conllu(spark, path), formats.conllu_corpus).tokens.select("sentence_id", "position", "word", "lemma", "wc", "pos", "root")


def _ignored(spark, sf_dir):
    """Items inserted twice, the second time with other counts and more items: the first stay."""
    rows = treebank(spark, sf_dir).tokens.groupBy("lemma").agg(F.count("*").alias("n"))

    def write(path):
        formats.insert_ignore(rows.where("lemma < 'm'"), path, ["lemma"])
        formats.insert_ignore(rows.withColumn("n", -F.col("n")), path, ["lemma"])

    return spark.read.schema(rows.schema).parquet(_files(spark, write))


def _tsv(spark, rows):
    path = _files(spark, lambda p: formats.write_tsv(rows, p))
    return spark.read.schema(rows.schema).csv(path, sep="\t", header=True)


def _merged(corpus, queries: dict):
    """Tables of the parts with even and with odd numbers, added up."""
    parts = []
    for name, q in queries.items():
        for k in (0, 1):
            half = Corpus(*(t.where(f"sentence_id % 2 = {k}") for t in (corpus.tokens, corpus.dependencies)))
            parts.append(cnt.contingency_of(half, split_association(q)).withColumn("query", F.lit(name)))
    return cnt.merge(*parts, by=("query",))


def _facts(spark, sf_dir):
    """What patterns are known by before they run."""
    some = {"obj": OBJ, "path": PATH, "two_amod": TWO_AMOD, "branched": BRANCHED, "shape": SHAPE, "crossed": Pattern(({}, {}, {}, {}), ((0, 1, {}), (2, 1, {}), (2, 3, {})))}
    rows = [(k, -1 if p.focus_point() is None else p.focus_point(), len(p.star_centers()), p.is_star(), p.without(*MARKS).is_purely_structural(), len(skeletize(p).edges)) for k, p in some.items()]
    return spark.createDataFrame(rows, "pattern string, focus int, centers int, star boolean, structural boolean, edges int")


def _with_names(rows, make):
    """The corpus with the numbers that its sentences are named by."""
    c = make(rows.withColumn("ord", F.expr("try_cast(original_id as long)")))
    return Corpus(c.tokens, c.dependencies)


def _cwb_read(spark, sf_dir):
    """The treebank written in the CWB format and read from the files."""
    path = _files(spark, lambda p: formats.cwb_text(treebank(spark, sf_dir)).select("value").write.text(p))
    return _with_names(formats.read_cwb(spark, path), formats.cwb_corpus).dependencies


def _fragments(bank):
    """The sentences with an even number, without their roots' labels; of those that 4 divides, also without the edges to position 2."""
    tokens = bank.tokens.where("sentence_id % 2 = 0").withColumn("root", F.lit(False))
    return Corpus(tokens, bank.dependencies.where("sentence_id % 2 = 0 and not (sentence_id % 4 = 0 and dependent = 2)"))


def _whole_sets(spark, sf_dir):
    """Single elements and pairs of the distinct parts of each supplier: arrays of more than 20 elements."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey <= 3").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ps"))
    return match.subsets(rows, "ps", 1, 2).selectExpr("cast(l_suppkey as long) supplier", "array_join(subset, ' ') subset")


def _compiled(spark, sf_dir):
    bank = treebank(spark, sf_dir)
    return spark.sql(match.pattern_sql(NEGATED, "{t}", "{d}"), t=bank.tokens, d=bank.dependencies)


def _cwb_lines(spark, sf_dir):
    return formats.to_cwb(treebank(spark, sf_dir)).selectExpr("sentence_id", "position", "array_join(columns, '\t') line")


def _cap(spark, sf_dir, how):
    sizes = treebank(spark, sf_dir).tokens.groupBy("sentence_id").agg(F.count("*").alias("size"))
    return formats.capped(sizes, "sentence_id", **how).select("sentence_id")


def _rank_correlation(corpus):
    rows = col.collexemes(corpus, COLLEXEME)
    return formats.rank_correlations(rows.withColumns({m: F.round(m, 12) for m in ("log_likelihood", "t_score", "dice")}), ["log_likelihood", "t_score", "dice"], "lemma", _R)


def _bins(spark, sf_dir):
    sizes = treebank(spark, sf_dir).tokens.groupBy("sentence_id").agg(F.count("*").alias("size"))
    return formats.binned(sizes, "size", 4)


QUERIES = {
    "association_strength": lambda s, d: cnt.association(treebank(s, d), split_association(ASSOCIATION), _R),
    "association_inconsistent": lambda s, d: cnt.association(treebank(s, d), split_association(INCONSISTENT), _R),
    "tokens": _bank(lambda c: c.tokens),
    "dependencies": _bank(lambda c: c.dependencies),
    "degrees": _bank(lambda c: c.tokens.groupBy("indegree", "outdegree").agg(F.count("*").alias("tokens"))),
    "renumber": lambda s, d: treebank(s, d, raw=True).tokens.select("sentence_id", "position", "lemma", "indegree", "outdegree"),
    "filter_eq": _bank(lambda c: compiler.candidates(c, {"wc": "VERB", "pos": "F"})),
    "filter_not": _bank(lambda c: compiler.candidates(c, {"not_wc": "VERB", "not_root": "root"})),
    "filter_not_indep": _bank(lambda c: compiler.candidates(c, {"wc": "NOUN", "not_indep": ["obj", "conj"]})),
    "filter_not_outdep": _bank(lambda c: compiler.candidates(c, {"wc": "VERB", "not_outdep": ["iobj", "obl"]})),
    "filter_degree": _bank(lambda c: compiler.candidates(c, {}, degrees=(1, 2))),
    "filter_regexp": _bank(lambda c: compiler.candidates(c, {"word": "^[a-m].*/F$", "not_lemma": "[xyz]"}, regexp=True)),
    "size_reject": _bank(lambda c: match.large_enough(c, TWO_AMOD)),
    "candidate_sentences": _bank(lambda c: compiler.candidate_sentences(c, NEGATED)),
    "sensible_sentences": lambda s, d: graphs.sensible_sentences(treebank(s, d, raw=True)),
    "reachable": _reach,
    "ego_edges": _bank(graphs.ego_edges),
    "match_edge": _bank(lambda c: compiler.embeddings(c, OBJ)),
    "match_path3": _bank(lambda c: compiler.embeddings(c, PATH)),
    "match_star3": _bank(lambda c: compiler.embeddings(c, TWO_AMOD)),
    "match_structural": _bank(lambda c: compiler.embeddings(c, SHAPE)),
    "match_negated": _bank(lambda c: compiler.embeddings(c, NEGATED)),
    "exists_pattern": _bank(lambda c: match.subsumed(c, PATH)),
    "rooted_matches": _bank(lambda c: match.rooted(c, TWO_AMOD, 0)),
    "rooted_at_places": _bank(lambda c: match.rooted_at(c, TWO_AMOD, 0, c.tokens.where("position < 2").select("sentence_id", F.col("position").alias("focus")))),
    "fixed_pair_count": _bank(lambda c: match.count_fixed(c, TWO_AMOD, 0, c.tokens.where("root").select("sentence_id", "position")).select("sentence_id", "embeddings")),
    "neighbourhood": _bank(_near),
    "candidate_sets": _bank(lambda c: match.candidate_sets(c, NEGATED, consistent=False)),
    "arc_consistency": _bank(lambda c: match.candidate_sets(c, OBJ)),
    "folded_candidates": _bank(lambda c: match.folded(compiler.embeddings(c, TWO_AMOD), TWO_AMOD).selectExpr("sentence_id", "array_join(m0, ' ') m0", "array_join(m1, ' ') m1")),
    "compiled_sql": _compiled,
    "breadth_first": _bank(match.breadth_first),
    "breadth_first_fragments": lambda s, d: match.breadth_first(_fragments(treebank(s, d)), fragment=True),
    "corpus_order": _bank(lambda c: match.in_corpus_order(match.breadth_first(c), c.sizes().selectExpr("sentence_id", "sequence(0, cast(least(n_tokens, 3) as int) - 1) places"), "places").selectExpr("sentence_id", "array_join(places, ' ') places")),
    "powerset_whole": lambda s, d: _whole_sets(s, d),
    "powerset": _bank(lambda c: match.subsets(c.dependencies.groupBy("sentence_id", "governor").agg(F.array_sort(F.collect_list("dependent")).alias("ds")), "ds", 2, 2).selectExpr("sentence_id", "governor", "subset[0] a", "subset[1] b")),
    "contingency_cells": _bank(lambda c: col.collexemes(c, COLLEXEME).select("lemma", *[rounded(x, _R).alias(k) for k, x in Table().cells().items()])),
    "count_methods": _bank(lambda c: cnt.method_counts(c, TWO_AMOD, 0)),
    "legacy_subgraph_count": lambda s, d: cnt.edge_set_subgraphs(treebank(s, d), split_association(BRANCHED)),
    "legacy_isomorphisms": lambda s, d: cnt.isomorphism_counts(treebank(s, d), split_association(INCONSISTENT)),
    "legacy_bundle": lambda s, d: cnt.legacy_bundle(treebank(s, d), split_association(ASSOCIATION)),
    "legacy_choke_points": lambda s, d: cnt.choke_points(treebank(s, d), split_association(ASSOCIATION)),
    "legacy_sentences": lambda s, d: cnt.sentence_signatures(treebank(s, d), split_association(ASSOCIATION)),
    "collexemes": _bank(lambda c: col.collexemes(c, COLLEXEME, digits=_R)),
    "collexeme_topk": _bank(lambda c: col.top(col.collexemes(c, COLLEXEME, digits=_R), 10, "log_likelihood", "lemma")),
    "covarying": _bank(lambda c: col.covarying(c, COVARYING, digits=_R)),
    "covarying_inconsistencies": _bank(lambda c: col.covarying(c, SYMMETRIC, digits=_R)),
    "larger_structures": _bank(_larger_signatures),
    "star_frequencies": _bank(lambda c: _stars(c, "edge")),
    "skeleton_frequencies": _bank(lambda c: _stars(c, "skeleton")),
    "edge_to_skeleton": _bank(_edge_to_skeleton),
    "connected_vertex_sets": _bank(lambda c: _flat(structures.connected_vertex_sets(c, 3, 3))),
    "connected_subgraphs": _bank(lambda c: _flat(structures.connected_subgraphs(c, 3, 3, edges=2))),
    "token_cap": lambda s, d: _cap(s, d, {"max_tokens": 1000}),
    "sentence_cap": lambda s, d: _cap(s, d, {"max_sentences": 100}),
    "generated_ids": _bank(lambda c: formats.generated_ids(c.tokens.select("sentence_id").distinct(), "sentence_id")),
    "upos_mapping": lambda s, d: _tagged(s, d).select("id", tags.upos(F.col("lemma"), F.col("tag"), F.col("rel"), F.col("gov")).alias("upos")),
    "wordclass_mapping": lambda s, d: _tagged(s, d).select("id", tags.word_class(F.col("tag")).alias("wc")),
    "conllu_parse": _conllu_lines,
    "cwb_parse": _cwb_read,
    "db_open": lambda s, d: _stored(s, d).tokens,
    "gzip_input": _gzipped,
    "insert_ignore": _ignored,
    "collexeme_tsv": lambda s, d: _tsv(s, col.collexemes(treebank(s, d), COLLEXEME, digits=_R)),
    "covarying_tsv": lambda s, d: _tsv(s, col.covarying(treebank(s, d), COVARYING, digits=_R)),
    "larger_structure_tsv": lambda s, d: _tsv(s, _larger_signatures(treebank(s, d))),
    "merged_parts": _bank(lambda c: _merged(c, {"association": ASSOCIATION, "inconsistent": INCONSISTENT})),
    "pattern_facts": _facts,
    "skeleton_match": _bank(lambda c: compiler.embeddings(c, skeletize(PATH))),
    "matrix_match": _bank(lambda c: match.matrix_embeddings(formats.to_adjacency(c), to_adjacency(TWO_AMOD))),
    "edge_list": _bank(lambda c: formats.to_edge_list(c)),
    "edge_list_roundtrip": _bank(lambda c: formats.from_edge_list(formats.to_edge_list(c))),
    "bracket_mapping": lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("cast(p_partkey as long) id", "element_at(array('-LRB-', '-RRB-', '-LSB-', '-RSB-', '-LCB-', '-RCB-', '(', 'x'), cast(p_partkey % 8 + 1 as int)) form").withColumn("form", tags.brackets(F.col("form"))),
    "batched": _bank(lambda c: formats.batched(c.tokens.select("sentence_id").distinct(), "sentence_id", 100)),
    "corenlp_json": _corenlp_json,
    "corenlp_xml": _corenlp_xml,
    "association_tsv": _association_tsv,
    "adjacency_roundtrip": _bank(lambda c: formats.from_adjacency(formats.to_adjacency(c)).dependencies),
    "chemical_export": _bank(lambda c: formats.to_chemical(c).selectExpr("sentence_id", "value")),
    "cwb_export": _cwb_lines,
    "json_roundtrip": _bank(lambda c: formats.from_json(formats.to_json(c)).dependencies),
    "rank_correlation": _bank(_rank_correlation),
    "int_bins": _bins,
    **{f"measure_{m}": _measure_query(m) for m in MEASURES},
}

# All stars by hand: a centre, some of its edges, some of the edges among their other ends.
_STARS = """i as (select sentence_id, governor v, dependent w, 'o:' || relation lab from d union all select sentence_id, dependent, governor, 'i:' || relation from d),
n as (select sentence_id, v, list({{'w': w, 'lab': lab}} order by w) xs from i group by all),
m as materialized (select row_number() over () r, sentence_id, v, list_filter(xs, lambda x, k: (mask >> (k - 1)) & 1 = 1) xs from (select *, unnest(range(1, (1 << len(xs))::bigint)) mask from n)),
p as (select r, sentence_id, unnest(xs, recursive := true) from m where len(xs) > 1),
z as (select a.r, list({{'g': a.w, 'd': b.w, 'la': a.lab, 'lb': b.lab, 'rel': relation}}) es from p a join d on d.sentence_id = a.sentence_id and governor = a.w join p b on b.r = a.r and dependent = b.w group by a.r),
y as (select *, list_filter(coalesce(es, []), lambda e, k: (side >> (k - 1)) & 1 = 1) ss from (select m.r, sentence_id, v, xs, es, unnest(range(0, (1 << len(coalesce(es, [])))::bigint)) side from m left join z on z.r = m.r)),
s as materialized (select sentence_id, v, len(xs) + 1 length,
  array_to_string(list_sort(list_transform(xs, lambda x: x.lab)), ';') || '|' || array_to_string(list_sort(list_transform(ss, lambda e: e.la || '>' || e.lb || '=' || e.rel)), ';') star,
  array_to_string(list_sort(list_transform(xs, lambda x: x.lab[1:2])), ';') || '|' || array_to_string(list_sort(list_transform(ss, lambda e: e.la[1:2] || '>' || e.lb[1:2] || '=')), ';') skeleton,
  array_to_string(list_reverse_sort(list_concat([len(xs)], list_transform(xs, lambda x: 1 + len(list_filter(ss, lambda e: e.g = x.w or e.d = x.w))))), ' ') degrees,
  array_to_string(list_sort(list_concat(list_transform(xs, lambda x: x.lab[3:]), list_transform(ss, lambda e: e.rel))), ' ') relations from y)""".replace("{{", "{").replace("}}", "}")

# What surrounds a verb up to two vertices, all of them next to it: by its edges to them, and by an edge between them.
_AROUND = """l as (select lemma from t group by lemma order by count(*) desc, lemma limit 1),
q as (select sentence_id, position v, lemma = (select lemma from l) fa from t where wc = 'VERB'),
i as (select e.sentence_id, v, w, wc || ':' || lab lab, wc || ':' bare from (select sentence_id, governor v, dependent w, 'o:' || relation lab from d union all select sentence_id, dependent, governor, 'i:' || relation from d) e join t on t.sentence_id = e.sentence_id and position = w),
ab as (select a.sentence_id, a.v, a.w x, b.w y, a.lab la, b.lab lb, a.bare ba, b.bare bb from i a join i b on a.sentence_id = b.sentence_id and a.v = b.v and a.w < b.w),
sd as (select ab.*, governor = x fwd, relation from ab join d on d.sentence_id = ab.sentence_id and ((governor = x and dependent = y) or (governor = y and dependent = x))),
p as (select sentence_id, v, [la, lb] ls, '' side from ab union all
  select sentence_id, v, [a, b], case when fwd then a || '>' || b else b || '>' || a end || '=' || relation from (select sentence_id, v, fwd, relation, la a, lb b from sd union all select sentence_id, v, fwd, relation, la, bb from sd union all select sentence_id, v, fwd, relation, ba, lb from sd)),
k as materialized (select distinct sentence_id, v, larger_structure, fa from (select sentence_id, v, lab || '|' larger_structure from i union all select sentence_id, v, array_to_string(list_sort(ls), ';') || '|' || side from p) join q using (sentence_id, v)),
u as (select unnest(['embeddings', 'subgraphs', 'focus_points']) as method, sentence_id, v, larger_structure, fa from k union all select 'sentences', sentence_id, 0, larger_structure, max(fa) from k group by all),
own as (select unnest(['embeddings', 'subgraphs', 'focus_points']) as method, sentence_id, v, fa from q union all select 'sentences', sentence_id, 0, max(fa) from q group by sentence_id),
g as (select larger_structure, u.method, count(*) filter (u.fa) o11, count(*) b, count(*) filter (own.fa) ab from u join own on u.method = own.method and u.sentence_id = own.sentence_id and u.v = own.v group by all),
r as (select larger_structure, g.method, o11::double o11, a - (ab - o11) / 2 r1, b - (ab - o11) / 2 c1, n::double n, (ab - o11)::bigint inconsistent from g join (select method, count(*) n, count(*) filter (fa) a from own group by method) using (method)
  where larger_structure in (select larger_structure from g where method = 'sentences' and o11 >= 2) and o11 > 0)"""

# Breadth-first order: by the fewest steps, then by the smallest way of (relation, place); starts come in their own order.
_WALKS = """ways(sentence_id, position, steps, way) as (select sentence_id, position, 0, [('', position)] from ({start}) union all
  select w.sentence_id, dependent, steps + 1, list_append(way, (relation, dependent)) from ways w join d on d.sentence_id = w.sentence_id and d.governor = w.position where steps < 20),
ranked as (select sentence_id, position, cast(row_number() over (partition by sentence_id order by steps, way) - 1 as int) as rank from
  (select sentence_id, position, steps, min(way) way from ways w where steps = (select min(steps) from ways v where v.sentence_id = w.sentence_id and v.position = w.position) group by all))"""

ORACLES = {
    "association_strength": _association_sql(_ASS_FLAGS),
    "association_inconsistent": _association_sql(_INC_FLAGS),
    "tokens": f"{TREE} select sentence_id, position, word, pos, lemma, wc, indegree, outdegree, root from t",
    "dependencies": f"{TREE} select * from d",
    "degrees": f"{TREE} select indegree, outdegree, count(*) tokens from t group by all",
    "renumber": f"{RAW} select sentence_id, position, lemma, indegree, outdegree from t",
    "filter_eq": f"{TREE} select sentence_id, position from t where wc = 'VERB' and pos = 'F'",
    "filter_not": f"{TREE} select sentence_id, position from t where wc <> 'VERB' and not root",
    "filter_not_indep": f"{TREE} select sentence_id, position from t where wc = 'NOUN' and not exists (select 1 from d where d.sentence_id = t.sentence_id and dependent = position and relation in ('obj', 'conj'))",
    "filter_not_outdep": f"{TREE} select sentence_id, position from t where wc = 'VERB' and not exists (select 1 from d where d.sentence_id = t.sentence_id and governor = position and relation in ('iobj', 'obl'))",
    "filter_degree": f"{TREE} select sentence_id, position from t where indegree >= 1 and outdegree >= 2",
    "filter_regexp": f"{TREE} select sentence_id, position from t where regexp_matches(word, '^[a-m].*/F$') and not regexp_matches(lemma, '[xyz]')",
    "size_reject": f"{TREE} select sentence_id from t group by sentence_id having count(*) >= 3 and (select count(*) from d where d.sentence_id = t.sentence_id) >= 2",
    "candidate_sentences": f"""{TREE} select sentence_id from t where wc = 'VERB' and outdegree >= 1 and not exists (select 1 from d where d.sentence_id = t.sentence_id and governor = position and relation in ('iobj', 'obl'))
  intersect select sentence_id from t where wc <> 'VERB' and indegree >= 1 and not exists (select 1 from d where d.sentence_id = t.sentence_id and dependent = position and relation = 'conj')""",
    "sensible_sentences": f"""{RAW}, r(sentence_id, position) as (select sentence_id, position from t where root union select r.sentence_id, dependent from r join d on d.sentence_id = r.sentence_id and governor = r.position)
select sentence_id from (select sentence_id, count(*) n, count(*) filter (root) roots, max(outdegree) o from t group by sentence_id) a join (select sentence_id, count(*) k from r group by sentence_id) b using (sentence_id) where n = k and roots = 1 and o <= 10""",
    "reachable": f"""{RAW}, r(sentence_id, position, hops) as (select sentence_id, position, 0 from t where root union select r.sentence_id, dependent, hops + 1 from r join d on d.sentence_id = r.sentence_id and governor = r.position)
select sentence_id, position, min(hops)::int hops from r group by all""",
    "ego_edges": f"""{TREE}, e as (select sentence_id, governor v, dependent w from d union select sentence_id, dependent, governor from d union select sentence_id, governor, governor from d union select sentence_id, dependent, dependent from d)
select d.sentence_id, a.v as position, count(*) edges from d join e a on a.sentence_id = d.sentence_id and a.w = governor join e b on b.sentence_id = d.sentence_id and b.w = dependent and b.v = a.v group by all""",
    "match_edge": f"{TREE} select d.sentence_id, governor m0, dependent m1 from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and b.wc = 'NOUN' and relation = 'obj'",
    "match_path3": f"{TREE} select x.sentence_id, x.governor m0, x.dependent m1, y.dependent m2 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.dependent join t a on a.sentence_id = x.sentence_id and a.position = x.governor join t c on c.sentence_id = x.sentence_id and c.position = y.dependent where a.wc = 'VERB' and c.wc = 'NOUN' and y.relation <> 'det' and x.governor <> y.dependent",
    "match_star3": f"{TREE} select x.sentence_id, x.governor m0, x.dependent m1, y.dependent m2 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor where x.relation = 'amod' and y.relation = 'amod' and x.dependent <> y.dependent",
    "match_structural": f"{TREE} select x.sentence_id, x.governor m0, x.dependent m1, y.dependent m2 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.dependent where x.governor <> y.dependent",
    "match_negated": f"{TREE} select d.sentence_id, governor m0, dependent m1 from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and b.wc <> 'VERB' and relation = 'obj' and not exists (select 1 from d z where z.sentence_id = a.sentence_id and z.governor = a.position and z.relation in ('iobj', 'obl')) and not exists (select 1 from d z where z.sentence_id = b.sentence_id and z.dependent = b.position and z.relation = 'conj')",
    "exists_pattern": f"{TREE} select distinct x.sentence_id from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.dependent join t a on a.sentence_id = x.sentence_id and a.position = x.governor join t c on c.sentence_id = x.sentence_id and c.position = y.dependent where a.wc = 'VERB' and c.wc = 'NOUN' and y.relation <> 'det' and x.governor <> y.dependent",
    "rooted_matches": f"{TREE} select sentence_id, governor focus from d where relation = 'amod' group by all having count(*) >= 2",
    "rooted_at_places": f"{TREE} select sentence_id, governor focus from d where relation = 'amod' and governor < 2 group by all having count(*) >= 2",
    "fixed_pair_count": f"{TREE} select t.sentence_id, count(governor) * (count(governor) - 1) embeddings from t left join d on d.sentence_id = t.sentence_id and governor = t.position and relation = 'amod' where root group by t.sentence_id",
    "neighbourhood": f"""{TREE}, e as (select distinct d.sentence_id, least(governor, dependent) x, greatest(governor, dependent) y from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and b.wc = 'NOUN' and relation = 'obj'),
z as (select e.*, unnest([governor, dependent]) v from e join d on d.sentence_id = e.sentence_id and (governor in (x, y) or dependent in (x, y)))
select sentence_id, x || ' ' || y vertices, string_agg(distinct v::varchar, ' ' order by v) neighbourhood from (select sentence_id, x, y, v from z group by all) group by sentence_id, x, y""".replace("string_agg(distinct v::varchar, ' ' order by v)", "array_to_string(list_sort(list(distinct v)), ' ')"),
    "candidate_sets": f"""{TREE} select sentence_id, 0 vertex, position from t where wc = 'VERB' and outdegree >= 1 and not exists (select 1 from d where d.sentence_id = t.sentence_id and governor = position and relation in ('iobj', 'obl'))
  union all select sentence_id, 1, position from t where wc <> 'VERB' and indegree >= 1 and not exists (select 1 from d where d.sentence_id = t.sentence_id and dependent = position and relation = 'conj')""",
    "arc_consistency": f"""{TREE}, m as (select d.sentence_id, governor m0, dependent m1 from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and b.wc = 'NOUN' and relation = 'obj')
select distinct sentence_id, 0 vertex, m0 as position from m union all select distinct sentence_id, 1, m1 from m""",
    "folded_candidates": f"""{TREE}, m as (select x.sentence_id, x.governor m0, x.dependent m1 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor where x.relation = 'amod' and y.relation = 'amod' and x.dependent <> y.dependent)
select sentence_id, array_to_string(list_sort(list(distinct m0)), ' ') m0, array_to_string(list_sort(list(distinct m1)), ' ') m1 from m group by sentence_id""",
    "compiled_sql": f"{TREE} select d.sentence_id, governor m0, dependent m1 from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and b.wc <> 'VERB' and relation = 'obj' and not exists (select 1 from d z where z.sentence_id = a.sentence_id and z.governor = a.position and z.relation in ('iobj', 'obl')) and not exists (select 1 from d z where z.sentence_id = b.sentence_id and z.dependent = b.position and z.relation = 'conj')",
    "powerset": f"{TREE} select x.sentence_id, x.governor, x.dependent a, y.dependent b from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor and x.dependent < y.dependent",
    "contingency_cells": f"{TREE} select lemma, " + ", ".join(f"round({x}, {_R}) + 0::double {x}" for x in ("o11", "o12", "o21", "o22", "r1", "r2", "c1", "c2", "n", "e11", "e12", "e21", "e22")) + f" from ({_CELLS} from ({_COLLEX_ROWS}))",
    "count_methods": f"""{TREE}, m as (select x.sentence_id, x.governor m0, x.dependent m1, y.dependent m2 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor where x.relation = 'amod' and y.relation = 'amod' and x.dependent <> y.dependent)
select 'embeddings' as method, count(*) n from m union all select 'subgraphs', count(distinct (sentence_id, list_sort([m0, m1, m2]))) from m union all select 'focus_points', count(distinct (sentence_id, m0)) from m union all select 'sentences', count(distinct sentence_id) from m""",
    "legacy_subgraph_count": _legacy_sql(_BRANCHED_FLAGS, "m0 || ',' || a || ',' || b", "subgraphs"),
    "legacy_isomorphisms": _legacy_sql(_INC_FLAGS, "m0 || ',' || m1", "embeddings"),
    "legacy_bundle": " union all ".join(f"select * from ({_legacy_sql(flags, unit, name)})" for flags, unit, name in ((_ASS_FLAGS, "m0", "embeddings"), (_ASS_FLAGS, "m0", "subgraphs"), (_ASS_FLAGS, "m0", "focus_points"), (_SENT_FLAGS, "0", "sentences"))),
    "legacy_choke_points": _legacy_sql(_ASS_FLAGS, "m0", "focus_points"),
    "legacy_sentences": _legacy_sql(_SENT_FLAGS, "0", "sentences"),
    "collexemes": f"{TREE} " + _measured(_COLLEX_ROWS, "lemma").replace("R1 r1", "r1::bigint r1").replace("C1 c1", "c1::bigint c1"),
    "collexeme_topk": f"{TREE} select * from (" + _measured(_COLLEX_ROWS, "lemma").replace("R1 r1", "r1::bigint r1").replace("C1 c1", "c1::bigint c1") + ") order by log_likelihood desc nulls last, lemma desc limit 10",
    "covarying": _covarying_sql("select d.sentence_id, a.lemma item_a, b.lemma item_b, governor || ',' || dependent emb, least(governor, dependent) || ',' || greatest(governor, dependent) sub, governor::varchar foc from d join t a on a.sentence_id = d.sentence_id and a.position = governor join t b on b.sentence_id = d.sentence_id and b.position = dependent where a.wc = 'VERB' and relation = 'amod'", "sub", "foc"),
    "covarying_inconsistencies": _covarying_sql("select x.sentence_id, a.lemma item_a, b.lemma item_b, x.governor || ',' || x.dependent || ',' || y.dependent emb, x.governor || ',' || least(x.dependent, y.dependent) || ',' || greatest(x.dependent, y.dependent) sub, x.governor::varchar foc from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.governor join t a on a.sentence_id = x.sentence_id and a.position = x.dependent join t b on b.sentence_id = x.sentence_id and b.position = y.dependent where x.relation = 'amod' and y.relation = 'amod' and x.dependent <> y.dependent", "sub", "foc"),
    "star_frequencies": f"{TREE}, {_STARS} select star, length, degrees, relations, pos, wc, count(*) star_freq, count(distinct (s.sentence_id, v)) center_freq from s join t on t.sentence_id = s.sentence_id and position = v group by all",
    "skeleton_frequencies": f"{TREE}, {_STARS} select skeleton star, length, degrees, count(*) star_freq, count(distinct (sentence_id, v)) center_freq from s group by all",
    "edge_to_skeleton": f"{TREE}, {_STARS} select star, array_to_string(list_sort(list(distinct skeleton)), ' ') skeletons from s group by star",
    "larger_structures": f"{TREE}, {_AROUND} " + _measured("select * from r", "larger_structure, method", ", inconsistent").replace("R1 r1", "r1::double r1").replace("C1 c1", "c1::double c1"),
    "connected_vertex_sets": f"""{TREE}, e as (select sentence_id, governor v, dependent w from d union select sentence_id, dependent, governor from d),
s as (select distinct x.sentence_id, list_sort([x.v, x.w, y.w]) vs from e x join e y on y.sentence_id = x.sentence_id and y.v = x.v and y.w <> x.w)
select s.sentence_id, array_to_string(vs, ' ') vertices, string_agg(governor || '>' || dependent, ' ' order by governor, dependent) edges from s join d on d.sentence_id = s.sentence_id and governor in (vs[1], vs[2], vs[3]) and dependent in (vs[1], vs[2], vs[3]) group by s.sentence_id, vs""",
    "connected_subgraphs": f"""{TREE} select x.sentence_id, array_to_string(list_sort(list_distinct([x.governor, x.dependent, y.governor, y.dependent])), ' ') vertices, x.governor || '>' || x.dependent || ' ' || y.governor || '>' || y.dependent edges
from d x join d y on y.sentence_id = x.sentence_id and (x.governor, x.dependent) < (y.governor, y.dependent) and (x.governor in (y.governor, y.dependent) or x.dependent in (y.governor, y.dependent)) where len(list_distinct([x.governor, x.dependent, y.governor, y.dependent])) = 3""",
    "token_cap": f"{TREE}, z as (select sentence_id, count(*) size from t group by sentence_id) select sentence_id from (select sentence_id, coalesce(sum(size) over (order by sentence_id rows between unbounded preceding and 1 preceding), 0) before from z) where before <= 1000",
    "sentence_cap": f"{TREE} select distinct sentence_id from t order by sentence_id limit 100",
    "generated_ids": f"{TREE} select sentence_id, 's-' || row_number() over (order by sentence_id) original_id from (select distinct sentence_id from t)",
    "upos_mapping": f"""with {_TAGGED} select id, case when tag = 'CC' then 'CONJ' when tag = 'CD' then 'NUM' when tag = 'EX' then 'PRON' when tag = 'JJ' then 'ADJ'
  when tag = 'TO' then case when rel = 'mark' and gov = 'VB' then 'PART' else 'ADP' end when tag = 'VBZ' then case when rel = 'aux' then 'AUX' else 'VERB' end
  when tag = 'IN' then case when rel = 'mark' then 'SCONJ' else 'ADP' end when tag = 'NN' then case lemma when '%' then 'SYM' when 'someone' then 'PRON' else 'NOUN' end
  when tag = 'NFP' then case when lemma = '--' then 'PUNCT' else 'SYM' end when tag = 'RB' then case when lemma = 'not' then 'PART' else 'ADV' end
  when tag in ('DT', 'WDT') then case when lemma = 'that' and rel <> 'det' then 'PRON' else 'DET' end else '_' end upos from b""",
    "wordclass_mapping": f"""with {_TAGGED} select id, case when tag in ('CD', 'JJ') then 'ADJ' when tag = 'RB' then 'ADV' when tag in ('CC', 'IN', 'TO') then 'CONJ/PREP' when tag = 'DT' then 'DET'
  when tag in ('EX', 'WDT') then 'PRON' when tag = 'NFP' then 'PUNC' when tag = 'NN' then 'SUBST' when tag = 'VBZ' then 'VERB' else 'UNKNOWN' end wc from b""",
    "conllu_parse": f"{TREE} select * from d",
    "cwb_parse": f"{TREE} select * from d",
    "db_open": f"{TREE} select sentence_id, position, word, pos, lemma, wc, indegree, outdegree, root from t",
    "gzip_input": f"{TREE} select sentence_id, position, word, lemma, wc, pos, root from t",
    "insert_ignore": f"{TREE} select lemma, case when lemma < 'm' then count(*) else -count(*) end n from t group by lemma",
    "merged_parts": " union all ".join(f"select '{k}' as query, * exclude (log_likelihood, t_score, dice) from ({_association_sql(f)})" for k, f in (("association", _ASS_FLAGS), ("inconsistent", _INC_FLAGS))),
    # By hand, from the drawings of the patterns.
    "pattern_facts": "select * from (values ('obj', 0, 2, true, false, 1), ('path', 0, 1, true, false, 2), ('two_amod', 0, 1, true, false, 2), ('branched', 0, 0, false, false, 4), ('shape', 0, 1, true, true, 2), ('crossed', -1, 0, false, true, 3)) v(pattern, focus, centers, star, structural, edges)",
    "skeleton_match": f"{TREE} select x.sentence_id, x.governor m0, x.dependent m1, y.dependent m2 from d x join d y on y.sentence_id = x.sentence_id and y.governor = x.dependent where x.governor <> y.dependent",
    "edge_list": f"""{TREE} select t.sentence_id, '[' || coalesce(string_agg('[' || governor || ', ' || dependent || ', "' || relation || '"]', ', ' order by governor, dependent), '') || ']' edges from (select distinct sentence_id from t) t left join d on d.sentence_id = t.sentence_id group by t.sentence_id""",
    "edge_list_roundtrip": f"{TREE} select * from d",
    "bracket_mapping": "select p_partkey::bigint id, (['(', ')', '[', ']', '{', '}', '(', 'x'])[(p_partkey % 8 + 1)::int] form from part",
    "batched": f"{TREE} select sentence_id, (row_number() over (order by sentence_id) - 1) // 100 batch from (select distinct sentence_id from t)",
    "adjacency_roundtrip": f"{TREE} select * from d",
    "association_tsv": f"select 1 query_number, " + ", ".join(f"max({x}) filter (method = '{m}') {m}_{x}" for m in cnt.METHODS for x in ("o11", "r1", "c1", "n", "inconsistent", "log_likelihood", "t_score", "dice")) + f" from ({_association_sql(_ASS_FLAGS)})",
    "chemical_export": f"""{TREE}, k as (select sentence_id, position, dense_rank() over (order by word, pos, lemma, wc) id from t), e as (select *, dense_rank() over (order by relation) id from d),
x as (select sentence_id, 0 k, position a, 0 b, 'v ' || position || ' ' || id l from k union all select sentence_id, 1, governor, dependent, 'e ' || governor || ' ' || dependent || ' ' || id from e)
select sentence_id, 't # ' || chr(10) || string_agg(l, chr(10) order by k, a, b) as value from x group by sentence_id""",
    "corenlp_json": f"""{TREE}, p as (select *, case wc when 'VERB' then 'VBZ' when 'NOUN' then 'NN' else 'JJ' end tag from t),
h as (select sentence_id, dependent as position, min(governor) + 1 head, arg_min(relation, governor) rel from d where relation <> 'conj' group by all),
e as (select sentence_id, dependent as position, string_agg((governor + 1) || ':' || relation, '|' order by governor, relation) deps from d group by all),
w as (select sentence_id, string_agg(word, ' ' order by position) as text from t group by all)
select p.sentence_id, w.text, concat_ws(chr(9), p.position + 1, word, lemma, wc, tag, '_', case when root then 0 else head end, case when root then 'root' else rel end, case when root then concat_ws('|', '0:root', deps) else deps end, '_') line
from p join w on w.sentence_id = p.sentence_id left join h on h.sentence_id = p.sentence_id and h.position = p.position left join e on e.sentence_id = p.sentence_id and e.position = p.position""",
    "corenlp_xml": f"""{TREE}, i as (select sentence_id, dependent as position, '|' || string_agg(relation || '(' || (governor - dependent) || ',0)', '|' order by governor) || '|' x from d group by all),
o as (select sentence_id, governor as position, '|' || string_agg(relation || '(0,' || (dependent - governor) || ')', '|' order by dependent) || '|' x from d group by all)
select t.sentence_id, t.position, concat_ws(chr(9), word, case wc when 'VERB' then 'VBZ' when 'NOUN' then 'NN' else 'JJ' end, lemma, case wc when 'VERB' then 'VERB' when 'NOUN' then 'SUBST' else 'ADJ' end, coalesce(i.x, '|'), coalesce(o.x, '|'), case when root then 'root' else '' end) line
from t left join i on i.sentence_id = t.sentence_id and i.position = t.position left join o on o.sentence_id = t.sentence_id and o.position = t.position""",
    "breadth_first": f"""{TREE}, {_WALKS.format(start="select sentence_id, position from t where root")} select sentence_id, position, rank from ranked""",
    "breadth_first_fragments": f"""{TREE}, e as (select * from d where sentence_id % 2 = 0 and not (sentence_id % 4 = 0 and dependent = 2)),
c(sentence_id, top, position) as (select sentence_id, position, position from t where sentence_id % 2 = 0 union select c.sentence_id, top, dependent from c join e on e.sentence_id = c.sentence_id and e.governor = c.position),
s as (select sentence_id, min(top) top from (select c.sentence_id, top from c join (select sentence_id, count(*) n from t group by sentence_id) k on k.sentence_id = c.sentence_id group by c.sentence_id, top, n having count(*) = n) group by sentence_id),
{_WALKS.replace(" d on", " e d on").format(start="select sentence_id, top as position from s union all select sentence_id, position from t where sentence_id % 2 = 0 and sentence_id not in (select sentence_id from s) and not exists (select 1 from e where e.sentence_id = t.sentence_id and e.dependent = t.position)")} select sentence_id, position, rank from ranked""",
    "corpus_order": f"""{TREE}, {_WALKS.format(start="select sentence_id, position from t where root")} select sentence_id, array_to_string(list_sort(list(position)), ' ') places from ranked where rank < 3 group by sentence_id""",
    "powerset_whole": """with p as (select distinct l_suppkey::bigint supplier, l_partkey k from lineitem where l_suppkey <= 3) select supplier, k::varchar subset from p union all select a.supplier, a.k || ' ' || b.k from p a join p b on a.supplier = b.supplier and a.k < b.k""",
    "json_roundtrip": f"{TREE} select * from d",
    "cwb_export": f"""{TREE}, i as (select sentence_id, dependent as position, '|' || string_agg(relation || '(' || (governor - dependent) || ',0)', '|' order by governor) || '|' x from d group by all),
o as (select sentence_id, governor as position, '|' || string_agg(relation || '(0,' || (dependent - governor) || ')', '|' order by dependent) || '|' x from d group by all)
select t.sentence_id, t.position, concat_ws(chr(9), word, pos, lemma, wc, coalesce(i.x, '|'), coalesce(o.x, '|'), case when root then 'root' else '' end) line from t left join i on i.sentence_id = t.sentence_id and i.position = t.position left join o on o.sentence_id = t.sentence_id and o.position = t.position""",
    "rank_correlation": f"""{TREE}, r as ({_measured(_COLLEX_ROWS, "lemma").replace("R1 r1", "r1").replace("C1 c1", "c1").replace(f", {_R})", ", 12)")}),
k as (select rank() over (order by log_likelihood) a, rank() over (order by t_score) b, rank() over (order by dice) c from r where log_likelihood is not null and t_score is not null and dice is not null)
select 'log_likelihood' measure_1, 't_score' measure_2, round(corr(a, b), {_R}) rho from k union all select 'log_likelihood', 'dice', round(corr(a, c), {_R}) from k union all select 't_score', 'dice', round(corr(b, c), {_R}) from k""",
    "int_bins": f"""{TREE}, z as (select sentence_id, count(*) size from t group by sentence_id), b as (select min(size) lo, max(size) hi from z),
w as (select lo, hi, case when hi <= lo + 3 then 1 else ceil((hi - lo + 1) / 4.0) end width from b)
select floor((size - lo) / width)::bigint bin, count(*) n from z, w group by all""",
    **{f"measure_{m}": f"{TREE} select lemma, round({x}, {_R}) + 0::double {m} from ({_CELLS} from ({_COLLEX_ROWS}))" for m, x in MEASURE_SQL.items()},
}
ORACLES |= {f"{k}_tsv": ORACLES[q] for k, q in (("collexeme", "collexemes"), ("covarying", "covarying"), ("larger_structure", "larger_structures"))} | {"matrix_match": ORACLES["match_star3"]}
