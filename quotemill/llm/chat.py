"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is the assistant, whose
turns are trained on, and all others are users that carry their names.  System turns stay system turns.

One row is one message of one rendering, so a conversation of any length is spread over tasks and no rendering is ever
gathered in one of them; sorted by (conv_id, perspective, turn) the ``rendered`` strings are the dialogue.

In ``rendered``, ``<|`` of contents and names becomes ``<\\|`` and white space in names ``_``, so that no text can forge a turn.

Defined results: roles are compared trimmed and in lower case; null or blank roles are the speaker ``unknown``, who is a
named user in all renderings and has none of its own; null texts are empty messages; a null conv_id is a conversation
of its own; repeated turns are repeated messages; a conversation of system turns
alone has no rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SPACE = "[ \t\n\r\f\x0b]+"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, perspective, turn, speaker, role, name,
    content, rendered, loss_mask, trained_chars, own_turns."""
    speaker = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    said = turns.select("conv_id", "turn", F.when(speaker == "", UNKNOWN).otherwise(speaker).alias("speaker"), F.coalesce("text", F.lit("")).alias("content"))
    present = said.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).groupBy("conv_id", "speaker").agg(F.count("*").alias("own_turns"))
    present = present.select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"), "own_turns")
    each = said.join(present, said["conv_id"].eqNullSafe(present["of"]))
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(~mine & (F.col("speaker") != SYSTEM), F.col("speaker"))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), safe(F.regexp_replace(name, SPACE, "_"))), F.lit("")), F.lit("\n"))
    return each.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("role"), name.alias("name"), "content",
        F.concat(head, safe(F.col("content")), F.lit(CLOSE + "\n")).alias("rendered"), mine.cast("int").alias("loss_mask"),
        F.when(mine, F.length("content")).otherwise(0).cast("long").alias("trained_chars"), F.col("own_turns").cast("long").alias("own_turns"),
    )


ORACLE = r"""
with said as (
  select conv_id, turn, case when lower(trim(coalesce(role, ''))) = '' then 'unknown' else lower(trim(role)) end as speaker,
         coalesce(text, '') as content
  from conversations),
present as (
  select conv_id as "of", speaker as perspective, count(*) as own_turns from said where speaker not in ('system', 'unknown') group by 1, 2),
each as (
  select *, speaker = perspective as mine from said join present on said.conv_id is not distinct from present."of")
select conv_id, perspective, turn, speaker,
       case when mine then 'assistant' when speaker = 'system' then 'system' else 'user' end as role,
       case when not mine and speaker <> 'system' then speaker end as name, content,
       '<|im_start|>' || case when mine then 'assistant' when speaker = 'system' then 'system' else 'user' end
         || coalesce(' name=' || replace(regexp_replace(case when not mine and speaker <> 'system' then speaker end, '[ \t\n\r\f\x0b]+', '_', 'g'), '<|', '<\|'), '') || chr(10) || replace(content, '<|', '<\|') || '<|im_end|>' || chr(10) as rendered,
       mine::int as loss_mask, (case when mine then length(content) else 0 end)::bigint as trained_chars, own_turns
from each
"""
