"""Preference formatting of conversations with DataFrame expressions.

The turns of a chosen and a rejected conversation are laid side by side by turn
number. Their longest common prefix is rendered once as the prompt; what follows
becomes two completions, each with the spans that are trained on (the assistant's
texts and their end mark). Markers inside texts are defused, so that no text can
open a turn.

Two aggregations do it: by (pair, turn), which joins the sides without a join,
and by pair. A record holds one conversation, as its reader needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, SHUT, END = "<|", "|>", "<|end|>\n"


def safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), safe(F.coalesce(role, F.lit("user"))), F.lit(SHUT + "\n"))


def pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per pair: prompt, prompt_turns, chosen, rejected and their trained spans.

    turns: one row per pair, side ('chosen' or 'rejected') and turn. Turns are
    compared by turn number, role and text. Spans are 'start:end' in characters
    of the completion, end exclusive, comma-joined. Rows with a null pair, turn
    or side are left out; a null role is 'user', a null text empty. Of rows
    repeated for one pair, side and turn the smallest (role, text) counts. If one
    side is a prefix of the other its completion is empty; equal sides give two
    empty completions. Other columns are ignored, whatever their names; whole texts
    are rendered, however long; an empty table gives an empty result.
    """
    rows = turns.select(F.col(pair).alias("pair_id"), F.col(side).alias("side"), F.col(turn).alias("turn"), F.struct(F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said"))
    rows = rows.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    both = rows.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("side") == "chosen", F.col("said"))).alias("c"), F.min(F.when(F.col("side") == "rejected", F.col("said"))).alias("r"))
    whole = both.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "c", "r"))).alias("t"))
    # The number of turns before the first that differs: null-safe, so a missing turn differs.
    common = F.coalesce(F.array_position(F.transform("t", lambda x: x["c"].eqNullSafe(x["r"])), False) - 1, F.lit(-1))
    whole = whole.withColumn("prompt_turns", F.when(common < 0, F.size("t")).otherwise(common).cast("int"))
    said = lambda x: F.concat(head(x["role"]), safe(x["text"]), F.lit(END))
    rest = F.slice("t", F.col("prompt_turns") + 1, F.greatest(F.size("t") - F.col("prompt_turns"), F.lit(0)))
    empty = F.expr("array()").cast("array<struct<start:int,end:int>>")

    def spans(name: str) -> Column:
        step = F.aggregate(
            F.filter(F.transform(rest, lambda x: x[name]), lambda x: x.isNotNull()),
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(said(x))).alias("at"),
                F.when(x["role"] == trained, F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(head(x["role"]))).alias("start"), (acc["at"] + F.length(said(x))).alias("end"))))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return F.array_join(F.transform(step["out"], lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    def completion(name: str) -> Column:
        return F.array_join(F.transform(F.filter(F.transform(rest, lambda x: x[name]), lambda x: x.isNotNull()), said), "")

    prompt = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("prompt_turns")), lambda x: said(x["c"])), "")
    return whole.select("pair_id", prompt.alias("prompt"), "prompt_turns", completion("c").alias("chosen"), completion("r").alias("rejected"), spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair from every conversation.

    There are no preferences among the tables. The chosen side is the
    conversation; in the rejected one the last assistant turn says what the last
    assistant turn of the next conversation (conv_id + 1) says, or nothing.
    """
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    reply = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("l.text").alias("reply"))
    ends = last.select("pair_id", F.col("l.turn").alias("last")).join(reply, "pair_id", "left")
    rejected = turns.join(ends, "pair_id", "left").withColumn("text", F.when(F.col("turn") == F.col("last"), F.coalesce("reply", F.lit(""))).otherwise(F.col("text")))
    return pairs(turns.withColumn("side", F.lit("chosen")).unionByName(rejected.select("pair_id", "turn", "role", "text").withColumn("side", F.lit("rejected"))))


OP7_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS last, max_by(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY pair_id),
b AS (SELECT t.pair_id, t.turn, t.role, t.text AS c, CASE WHEN t.turn = l.last THEN coalesce(n.text, '') ELSE t.text END AS r
  FROM t LEFT JOIN l USING (pair_id) LEFT JOIN l n ON n.pair_id = t.pair_id + 1),
f AS (SELECT *, coalesce(min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY pair_id), 1000000000) AS cut FROM b),
s AS (SELECT *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(c, '<|', '< |') || '<|end|>' || chr(10) AS ct, replace(r, '<|', '< |') || '<|end|>' || chr(10) AS rt FROM f),
a AS (SELECT *, coalesce(sum(CASE WHEN turn >= cut THEN length(head || ct) END) OVER w, 0) AS ce, coalesce(sum(CASE WHEN turn >= cut THEN length(head || rt) END) OVER w, 0) AS re
  FROM s WINDOW w AS (PARTITION BY pair_id ORDER BY turn))
SELECT pair_id,
  coalesce(string_agg(CASE WHEN turn < cut THEN head || ct END, '' ORDER BY turn), '') AS prompt,
  CAST(count(CASE WHEN turn < cut THEN 1 END) AS INT) AS prompt_turns,
  coalesce(string_agg(CASE WHEN turn >= cut THEN head || ct END, '' ORDER BY turn), '') AS chosen,
  coalesce(string_agg(CASE WHEN turn >= cut THEN head || rt END, '' ORDER BY turn), '') AS rejected,
  coalesce(string_agg(CASE WHEN turn >= cut AND role = 'assistant' THEN CAST(CAST(ce - length(ct) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ce AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN turn >= cut AND role = 'assistant' THEN CAST(CAST(re - length(rt) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(re AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn), '') AS rejected_spans
FROM a GROUP BY pair_id
"""
