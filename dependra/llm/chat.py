"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame operations only.

Logged conversations are often snapshots of one that went on. A rolling hash of every turn prefix is the exclusive or of hashes
of (position, role, text), 2 x 64 bits, as a running window. A conversation whose whole hash is a strict prefix of
another, or that equals one with a smaller conv_id, goes by an anti-join; the others are rendered.

Long conversations are scanned in two levels (blocks of turn numbers, then block totals) and rendered in parts of `block`
turns, so that no window or group holds one whole conversation. Parts in order make up the rendering.

Defined cases: turns order by turn (nulls first), role, text; repeated rows of a conversation count once. Positions, not turn
numbers, are compared. A null conv_id is a conversation of its own. Null roles and texts differ from empty ones in the comparison and render
as empty. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import Scratch, table


def _hash(seed: int) -> str:
    return f"xxhash64({seed}, pos, role is null, coalesce(role, ''), text is null, coalesce(text, ''))"


def maximal_conversations(turns: DataFrame, scratch: Scratch, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Turns with pos and the conversation's n_turns; and (conv_id, n_absorbed) of the maximal conversations."""
    order = "order by turn nulls first, role nulls first, text nulls first"
    over = f"partition by conv_id, b {order}"
    # Turns by block: places in the block, then the block's offset from the counts of those before it.
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("b", F.expr(f"coalesce(turn div {block}, -9223372036854775807)"))
    rows = scratch.save(rows.withColumn("at", F.expr(f"row_number() over ({over})")), "placed")
    before = rows.groupBy("conv_id", "b").agg(F.count("*").alias("n")).selectExpr(
        "conv_id cid", "b bb", "coalesce(sum(n) over (partition by conv_id order by b rows between unbounded preceding and 1 preceding), 0) before",
        "sum(n) over (partition by conv_id) n_turns")
    rows = rows.join(before, F.expr("conv_id <=> cid and b = bb")).selectExpr("conv_id", "b", "turn", "role", "text", "at + before - 1 pos", "n_turns")
    rows = rows.selectExpr("*", f"bit_xor({_hash(1)}) over ({over}) x", f"bit_xor({_hash(2)}) over ({over}) y")
    rows = scratch.save(rows, "hashed")
    totals = rows.groupBy("conv_id", "b").agg(F.max_by(F.struct("x", "y"), "pos").alias("t")).selectExpr(
        "conv_id cid", "b bb", *(f"coalesce(bit_xor(t.{c}) over (partition by conv_id order by b rows between unbounded preceding and 1 preceding), 0) {c}0" for c in "xy"))
    prefixes = rows.select("conv_id", "b", "pos", "n_turns", "x", "y").join(totals, F.expr("conv_id <=> cid and b = bb")).selectExpr("conv_id", "pos + 1 len", "n_turns", "x ^ x0 x", "y ^ y0 y")
    prefixes = scratch.save(prefixes, "prefixes")
    whole = prefixes.where("len = n_turns").groupBy("len", "x", "y").agg(F.expr("min(struct(conv_id is null no, conv_id)).conv_id").alias("conv_id"), F.count("*").alias("n"))
    whole = scratch.save(whole, "whole")
    strict = prefixes.where("len < n_turns")
    kept = whole.join(strict.select("len", "x", "y").distinct(), ["len", "x", "y"], "left_anti")
    inside = strict.join(whole.select("len", "x", "y", "n"), ["len", "x", "y"]).groupBy("conv_id").agg(F.sum("n").alias("inside")).withColumnRenamed("conv_id", "cid")
    return rows, kept.join(inside, F.expr("conv_id <=> cid"), "left").selectExpr("conv_id", "n - 1 + coalesce(inside, 0) n_absorbed")


def format_chats(turns: DataFrame, scratch: Scratch, block: int = 1024) -> DataFrame:
    """conv_id, part, n_turns, n_absorbed (conversations that are equal to it or prefixes of it), rendered."""
    rows, kept = maximal_conversations(turns, scratch, block)
    line = "concat('<|im_start|>', coalesce(role, ''), '\\n', coalesce(text, ''), '<|im_end|>\\n')"
    kept = kept.selectExpr("conv_id cid", "n_absorbed")
    parts = rows.join(kept, F.expr("conv_id <=> cid")).withColumn("part", F.expr(f"pos div {block}")).groupBy("conv_id", "part")
    parts = parts.agg(F.first("n_turns").alias("n_turns"), F.first("n_absorbed").alias("n_absorbed"), F.expr(f"array_sort(collect_list(struct(pos, {line} line)))").alias("ls"))
    return parts.selectExpr("conv_id", "part", "n_turns", "n_absorbed", "array_join(ls.line, '') rendered")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), Scratch(spark))


OP4_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
p as (select *, row_number() over w - 1 pos, count(*) over (partition by conv_id) n_turns,
      coalesce('V' || length(role) || ':' || role, 'N') || coalesce('V' || length(text) || ':' || text, 'N') tok
      from t window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
h as (select conv_id, pos + 1 len, n_turns, md5(string_agg(tok, '|') over (partition by conv_id order by pos)) x from p),
whole as (select len, x, min(conv_id) m, count(*) n from h where len = n_turns group by len, x),
kept as (select * from whole where not exists (select 1 from h where h.len < h.n_turns and h.len = whole.len and h.x = whole.x)),
inside as (select h.conv_id, sum(whole.n) n from h join whole on h.len = whole.len and h.x = whole.x where h.len < h.n_turns group by h.conv_id)
select p.conv_id, p.pos // 1024 part, any_value(p.n_turns) n_turns, any_value(kept.n - 1 + coalesce(inside.n, 0))::bigint n_absorbed,
       string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), '' order by p.pos) rendered
from p join kept on p.conv_id is not distinct from kept.m left join inside on p.conv_id is not distinct from inside.conv_id
group by p.conv_id, p.pos // 1024
"""
