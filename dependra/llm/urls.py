"""URL filters: rules, and a tree of path templates that carries their verdicts on.

Rules (verdict, host, path) fit a host and its subdomains where the path starts with the rule's; the longest wins. They
also label pages. For each host the paths make a tree: a segment of digits, hexadecimal digits or mixed letters and digits
becomes a wildcard at once, and a place in the tree with many different children for its rows becomes one, level by level.
At each level, the labelled branches below one place are told apart by their shares of blocked labels: above, below or like the
place's pooled share by a z test. Those of one kind that are like their kind's pooled share by the same test are merged, with all
that lies below them. A template is rejected if its smoothed share of blocked labels
reaches `purity`; the smoothing is towards the share over all labels. A template without labels has no purity and is allowed.

All counts are made before grouping: rows of one host are first counted by path pattern. Defined cases: null URLs and URLs
without `://` have an empty host and path, fit no rule and are judged as one template. Repeated pages count as often as they
occur. Segments from max_depth on are one tail of the template. Other columns pass through; host, path, rule, verdict,
template and purity are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (the longest that fits, ties to the first in code-point order) and label (block 1, allow 0)."""
    host = f"translate(regexp_extract(coalesce(url, ''), r'{_URL}', 1), '{_UPPER}', '{_LOWER}')"
    out = pages.withColumn("host", F.expr(host)).withColumn("path", F.expr(f"regexp_extract(coalesce(url, ''), r'{_URL}', 2)"))
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"when (host = {_lit(h)} or endswith(host, {_lit('.' + h)})) and startswith(path, {_lit(p)}) then" for _, h, p in ordered]
    rule = "case " + " ".join(f"{f} {_lit(h + p)}" for f, (_, h, p) in zip(fits, ordered)) + " end" if rules else "cast(null as string)"
    label = "case " + " ".join(f"{f} {int(v == 'block')}" for f, (v, _, _) in zip(fits, ordered)) + " end" if rules else "cast(null as int)"
    return out.withColumn("rule", F.expr(rule)).withColumn("label", F.expr(label))


def _pattern(max_depth: int) -> str:
    """The path's segments with the plainly variable ones as wildcards; what lies deeper than max_depth is one tail."""
    one = (r"case when rlike(s, r'^\\d+$') then '<n>' when rlike(s, r'^\\d+\\.\\w+$') then concat('<n>', regexp_extract(s, r'(\\.\\w+)$', 1))"
           r" when rlike(s, r'^[0-9a-fA-F-]{16,}$') then '<x>' when rlike(s, r'\\d{3,}') then '<m>' else s end").replace("\\\\", "\\")
    segments = f"transform(filter(split(path, '/'), s -> s <> ''), s -> {one})"
    return f"transform({segments}, (s, i) -> if(i < {max_depth}, s, '**'))"


def templates(labelled: DataFrame, scratch: Scratch, max_depth: int = 6, wide: int = 20, share: float = 0.2, z: float = 1.96, smooth: float = 4.0) -> DataFrame:
    """labelled: (host, raw, label). (host, raw, template, purity) for each host's patterns."""
    now = labelled.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("label").alias("k"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).withColumn("cur", F.col("raw"))
    now = scratch.save(now, "patterns_0")
    deepest = now.agg(F.max(F.size("cur"))).first()[0] or 0
    levels = min(deepest, max_depth + 1)
    for d in range(1, levels + 1):
        up, seg = F.slice("cur", 1, d - 1).alias("up"), F.expr(f"cur[{d - 1}]").alias("seg")
        new = lambda name: F.expr(f"concat(up, array({name}), slice(cur, {d + 1}, greatest(size(cur) - {d}, 0)))")  # noqa: E731, B023
        # A place with more than `wide` children, and a new child for every 1 / share rows or oftener, has a wildcard there.
        child = now.where(F.size("cur") >= d).groupBy("host", up, seg).agg(F.sum("n").alias("n"))
        open_ = child.groupBy("host", "up").agg(F.count("*").alias("children"), F.sum("n").alias("n")).where((F.col("children") > wide) & (F.col("children") >= F.col("n") * share)).selectExpr("host", "up", "true open")
        now = now.withColumn("up", up).join(open_, ["host", "up"], "left")
        now = scratch.save(now.withColumn("cur", F.when(F.expr(f"open and size(cur) >= {d}"), new("'*'")).otherwise(F.col("cur"))).drop("up", "open"), f"wild_{d}")
        # Labelled branches of a place that are alike are one, with all that lies below them.
        child = now.where((F.size("cur") >= d) & (F.col("k") > 0)).groupBy("host", up, seg).agg(F.sum("k").alias("bk"), F.sum("bad").alias("bbad"))
        kinds = ["host", "up"]
        for kind in ("kind", "same"):
            pool = child.groupBy(*kinds).agg(F.sum("bk").alias("pk"), F.sum("bbad").alias("pbad"))
            off, slack = "bbad - bk * (pbad / pk)", f"{z}D * sqrt(bk * (pbad / pk) * (1 - pbad / pk)) + 1e-9D"
            child = child.join(pool, kinds).withColumn(kind, F.expr(f"case when {off} > {slack} then '{{+}}' when -({off}) > {slack} then '{{-}}' else '{{~}}' end")).drop("pk", "pbad")
            kinds = [*kinds, kind]
        child = child.where("same = '{~}'")
        several = child.groupBy("host", "up", "kind").count().where("count > 1").select("host", "up", "kind")
        alike = child.join(several, ["host", "up", "kind"], "left_semi").selectExpr("host", "up", "seg", "kind alike")
        now = now.withColumn("up", up).withColumn("seg", F.expr(f"if(size(cur) >= {d}, cur[{d - 1}], null)")).join(alike, ["host", "up", "seg"], "left")
        now = scratch.save(now.withColumn("cur", F.when(F.col("alike").isNotNull(), new("alike")).otherwise(F.col("cur"))).drop("up", "seg", "alike"), f"patterns_{d}")
        scratch.drop(f"patterns_{d - 1}")
        scratch.drop(f"wild_{d}")
    base = now.agg(F.sum("bad"), F.sum("k")).first()
    base = (base[0] or 0) / base[1] if base[1] else 0.0
    leaf = now.groupBy("host", "cur").agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"))
    leaf = leaf.selectExpr("host", "cur", "concat('/', array_join(cur, '/')) template", f"if(k > 0, (bad + {smooth}D * {base!r}D) / (k + {smooth}D), null) purity")
    return scratch.save(now.select("host", "raw", "cur").join(leaf, ["host", "cur"]).select("host", "raw", "template", "purity"), "templates")


def filter_urls(pages: DataFrame, scratch: Scratch, rules=RULES, purity: float = 0.8, max_depth: int = 6, wide: int = 20) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "label", "verdict", "template", "purity", "raw")]
    rows = judged(pages.select(*names), rules).withColumn("raw", F.expr(_pattern(max_depth)))
    found = templates(rows.select("host", "raw", "label"), scratch, max_depth, wide)
    out = rows.join(found, ["host", "raw"], "left")
    verdict = f"case label when 1 then 'block' when 0 then 'allow' else if(coalesce(purity >= {purity}D, false), 'block', 'allow') end"
    return out.select(*names, "host", "path", "rule", F.expr(verdict).alias("verdict"), "template", "purity")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), Scratch(spark)).drop("url").withColumn("purity", F.round("purity", 9))


def _sql(depth: int = 7, wide: int = 20, share: float = 0.2, z: float = 1.96, smooth: float = 4.0, purity: float = 0.8) -> str:
    """The whole operator as SQL over lists of segments, level by level."""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    case = lambda out: "case " + " ".join(f"when {f} then {out(r, v)}" for f, r, v in fits) + " end"
    ctes = [f"""u as (select page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 0) <> '' ok, {low("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)")} host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) path from pages)""",
        f"j as (select *, {case(lambda r, v: repr(r))} as rule, {case(lambda r, v: int(v == 'block'))} as label from u)",
        rf"""r as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s, i: case when i > {depth - 1} then '**' when regexp_matches(s, '^\d+$') then '<n>'
  when regexp_matches(s, '^\d+\.\w+$') then '<n>' || regexp_extract(s, '(\.\w+)$', 1) when regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') then '<x>' when regexp_matches(s, '\d{{3,}}') then '<m>' else s end) raw from j)""",
        "p0 as materialized (select host, raw, count(*) n, count(label) k, coalesce(sum(label), 0) bad, raw as cur from r group by host, raw)"]
    for d in range(1, depth + 1):
        up, put = f"cur[1:{d - 1}]" if d > 1 else "[]::varchar[]", lambda x: f"list_concat({up}, ['{x}'], cur[{d + 1}:])"  # noqa: B023, E731
        ctes += [
            f"c{d} as (select host, {up} up, cur[{d}] seg, sum(n) n from p{d - 1} where len(cur) >= {d} group by all)",
            f"o{d} as (select host, up from c{d} group by all having count(*) > {wide} and count(*) >= sum(n) * {share}::double)",
            f"w{d} as materialized (select host, raw, n, k, bad, case when len(cur) >= {d} and (host, {up}) in (select (host, up) from o{d}) then {put('*')} else cur end as cur from p{d - 1})",
            f"b{d} as (select host, {up} up, cur[{d}] seg, sum(k)::double bk, sum(bad)::double bbad from w{d} where len(cur) >= {d} and k > 0 group by all)",
            f"k{d} as (select *, case when off > slack then '{{+}}' when -off > slack then '{{-}}' else '{{~}}' end kind from (select *, bbad - bk * s off, {z} * sqrt(bk * s * (1 - s)) + 1e-9 slack from (select *, sum(bbad) over w / sum(bk) over w s from b{d} window w as (partition by host, up))))",
            f"a{d} as (select host h, up u, seg g, kind from (select * exclude (s, off, slack), sum(bbad) over w / sum(bk) over w s from k{d} window w as (partition by host, up, kind)) where abs(bbad - bk * s) <= {z} * sqrt(bk * s * (1 - s)) + 1e-9 qualify count(*) over (partition by host, up, kind) > 1)",
            f"p{d} as materialized (select host, raw, n, k, bad, case when kind is not null then list_concat({up}, [kind], cur[{d + 1}:]) else cur end as cur from w{d} left join a{d} on host = h and u = {up} and g = cur[{d}] and len(cur) >= {d})"]
    ctes += [f"base as (select coalesce(sum(bad)::double / nullif(sum(k), 0), 0) base from p{depth})",
        f"leaf as (select host, cur, case when sum(k) > 0 then (sum(bad)::double + {smooth}::double * any_value(base)) / (sum(k)::double + {smooth}::double) end purity from p{depth}, base group by host, cur)"]
    return f"""with {", ".join(ctes)}
select page_id, r.host, path, rule, case label when 1 then 'block' when 0 then 'allow' else case when coalesce(purity >= {purity}, false) then 'block' else 'allow' end end verdict, '/' || array_to_string(p{depth}.cur, '/') as template, round(purity, 9) purity
from r join p{depth} on r.host = p{depth}.host and r.raw = p{depth}.raw join leaf on leaf.host = p{depth}.host and leaf.cur = p{depth}.cur"""


OP7_SQL = _sql()
