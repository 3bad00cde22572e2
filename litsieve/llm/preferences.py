"""Preference formatting: one prompt from the longest common turn prefix, and two masked completions.

A pair of conversations is split where their turns first differ.  The common turns are rendered once
as the prompt; each side's other turns are its completion, with the character ranges that a loss
should cover: the texts of assistant turns with their end mark.

A conversation is one training example and so one row; all else is one join of the two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the distinct messages of each conversation, by turn, role and text (nulls first)."""
    broken = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    message = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), broken.alias("text"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(message)).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """Ranges [start, stop) of the assistant texts and their end marks, in characters of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(turn["role"]) + 1
        stop = begin + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("stop")))
        spans = F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((stop + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Format ``pairs`` (pair_id, chosen_id, rejected_id) of ``conversations`` (conv_id, turn, role, text).

    Gives pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask and usable.  Turns are equal if role and text are.  A null role counts as user, a null
    text as empty; messages that repeat within a turn count once, others of one turn follow each other
    by role and text; rows with a null conv_id are left out, and template marks within a text are broken
    up.  A pair is not usable if a side is missing or without an assistant turn after the prompt, or if
    the sides are equal; such pairs are given, too.
    """
    turns = _turns(conversations)
    none = F.array().cast(turns.schema["turns"].dataType)
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        sides = sides.join(turns.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")), f"{side}_id", "left")
    a, b = F.coalesce("chosen_turns", none), F.coalesce("rejected_turns", none)
    sides = sides.withColumn("a", a).withColumn("b", b).withColumn("shorter", F.least(F.size("a"), F.size("b")))
    places = F.when(F.col("shorter") > 0, F.sequence(F.lit(1), F.col("shorter"))).otherwise(F.array().cast("array<int>"))

    def differ(i: Column) -> Column:
        x, y = F.element_at("a", i), F.element_at("b", i)
        return (x["role"] != y["role"]) | (x["text"] != y["text"])

    first = F.array_min(F.filter(places, differ))
    sides = sides.withColumn("prompt_turns", F.coalesce(first - 1, "shorter"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    sides = sides.withColumn("rest_a", rest("a")).withColumn("rest_b", rest("b"))
    answered = lambda c: F.exists(c, lambda t: t["role"] == "assistant")
    return sides.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        _text(F.slice("a", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        _text(F.col("rest_a")).alias("chosen"),
        _text(F.col("rest_b")).alias("rejected"),
        _spans(F.col("rest_a")).alias("chosen_mask"),
        _spans(F.col("rest_b")).alias("rejected_mask"),
        (answered("rest_a") & answered("rest_b")).alias("usable"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected); a side that does not exist is null."""
    ids = conversations.select("conv_id").where("conv_id is not null").distinct()
    pair = F.shiftright(F.col("conv_id").cast("long"), 1)  # half, rounded down, in whole numbers
    even = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))
    odd = F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))
    return ids.groupBy(pair.alias("pair_id")).agg(F.max(even).alias("chosen_id"), F.max(odd).alias("rejected_id"))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, 2k against 2k + 1; masks as text, so that SQL can say the same."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = format_preferences(conversations, neighbour_pairs(conversations))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return made.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", said("chosen_mask"), said("rejected_mask"), "usable")


def _oracle() -> str:
    render = f"'{OPEN}' || x.role || chr(10) || x.text || '{CLOSE}' || chr(10)"
    size = f"({len(OPEN) + len(CLOSE) + 2} + length(x.role) + length(x.text))"

    def text(turns: str) -> str:
        return f"array_to_string(list_transform({turns}, lambda x: {render}), '')"

    def mask(turns: str) -> str:
        begin = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda x: {size})), 0) + {len(OPEN) + 1} + length({turns}[i].role)"
        span = f"CAST(CAST({begin} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({begin} + length({turns}[i].text) + {len(CLOSE)} AS BIGINT) AS VARCHAR)"
        return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: {span}), ',')"

    return f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS t FROM said GROUP BY conv_id),
pairs AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id,
         max(conv_id) FILTER (conv_id % 2 <> 0) AS rejected_id FROM turns GROUP BY 1),
sides AS (
  SELECT pair_id, chosen_id, rejected_id, coalesce(c.t, []) AS a, coalesce(r.t, []) AS b
  FROM pairs LEFT JOIN turns c ON c.conv_id = chosen_id LEFT JOIN turns r ON r.conv_id = rejected_id),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS p FROM sides),
parts AS (SELECT *, a[p + 1:] AS ra, b[p + 1:] AS rb FROM cut)
SELECT pair_id, chosen_id, rejected_id, CAST(p AS INTEGER) AS prompt_turns, {text('a[1:p]')} AS prompt,
       {text('ra')} AS chosen, {text('rb')} AS rejected, {mask('ra')} AS chosen_mask, {mask('rb')} AS rejected_mask,
       len(list_filter(ra, lambda x: x.role = 'assistant')) > 0 AND len(list_filter(rb, lambda x: x.role = 'assistant')) > 0 AS usable
FROM parts"""


ORACLE = _oracle()
