"""Chat formatting: the dialogue once for each participant, with that speaker as the assistant.

A participant is a distinct role of a conversation other than ``system``. In a participant's view their turns are
rendered as assistant, other turns as user with the speaker's name, system turns as system; only the speaker's own
bodies (with their end mark) are trained on. One row holds one turn of one view with its place in the view's text, so
no row, task or group holds a whole dialogue: joining ``rendered`` in order of ``position`` gives the view, and
[mask_start, mask_end) are its trained code points. Positions and offsets are prefix sums in two levels, within blocks
of turns and over the blocks, so a conversation that holds much of the table is spread over tasks.

Null text is an empty body; a null role is the speaker ``unknown``; a null turn comes first; ties of a turn are ordered
by role and text, and equal rows are equal turns, each kept. Conversations whose only role is system have no view. A
null conv_id is a conversation of its own. Columns other than the four read are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Turns of a block of the prefix sums.
BLOCK = 1024


def views(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, speaker, position, turn, as_role, rendered, start, mask_start, mask_end) for each view and turn."""
    said = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    who = said.where("role <> 'system'").select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
    seen = said.join(who, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("role") == F.col("speaker")
    head = F.when(F.col("role") == "system", "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    seen = seen.select(
        "conv", "speaker", "turn", "role", "text", F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user").alias("as_role"),
        F.length(head).cast("long").alias("head"), F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("block"), own.alias("own"),
    ).withColumn("size", F.length("rendered").cast("long"))
    blocks = seen.groupBy("conv", "speaker", "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = "over (partition by conv, speaker order by block rows between unbounded preceding and 1 preceding)"
    base = blocks.select(F.col("conv").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), F.expr(f"coalesce(sum(n) {before}, 0L)").alias("n0"), F.expr(f"coalesce(sum(chars) {before}, 0L)").alias("at0"))
    order = "partition by conv, speaker, block order by turn, role, text"
    inner = seen.withColumn("n", F.expr(f"row_number() over ({order}) - 1")).withColumn("at", F.expr(f"coalesce(sum(size) over ({order} rows between unbounded preceding and 1 preceding), 0L)"))
    at = F.col("at") + F.col("at0")
    return inner.join(base, F.col("conv").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b"))).select(
        F.col("conv").alias(conv), "speaker", (F.col("n") + F.col("n0")).cast("long").alias("position"), "turn", "as_role", "rendered", at.alias("start"),
        F.when(F.col("own"), at + F.col("head")).otherwise(at).alias("mask_start"),
        F.when(F.col("own"), at + F.col("size") - 1).otherwise(at).alias("mask_end"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's view of every conversation, turn by turn."""
    return views(common.table(spark, sf_dir, "conversations"))


ORACLE = """
with said as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
who as (select distinct conv_id, role as speaker from said where role <> 'system'),
seen as (
  select s.*, speaker,
    case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user' end as as_role,
    case when role = 'system' then '<|system|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10)
      else '<|user name=' || role || '|>' || chr(10) end as head
  from said s join who w on s.conv_id is not distinct from w.conv_id),
put as (select *, head || text || '<|end|>' || chr(10) as rendered from seen),
placed as (
  select *, row_number() over w - 1 as position,
    cast(coalesce(sum(length(rendered)) over (partition by conv_id, speaker order by turn nulls first, role, text
      rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from put window w as (partition by conv_id, speaker order by turn nulls first, role, text))
select conv_id, speaker, position, turn, as_role, rendered, start,
  case when role = speaker then start + length(head) else start end as mask_start,
  case when role = speaker then start + length(rendered) - 1 else start end as mask_end
from placed
"""
