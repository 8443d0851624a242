"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of the two conversations of a pair is
rendered once, as prompt; the turns after it are rendered as the chosen and
the rejected completion, each with the spans of its characters that carry loss
(the answers of the assistant and their end marks). A prompt carries none.

One row holds a pair, or, of a pair with turn numbers of ``PART_TURNS`` and
more, one block of turn numbers: ``part`` counts the blocks, a pair's prompt is
the prompts of its parts in order, and so are its completions. So no row grows
without bound, and a pair with any number of turns is spread over many tasks.
Turns are compared by hashes of their rows; the first turn in which the sides
differ is an aggregate of a few numbers per turn.

The pairs of ``query`` are made from plain conversations: a conversation is
chosen; its copy, with the last answer of the assistant replaced by the last
answer in the next conversation, is rejected. "Next" is the next larger id
with an answer among the conversations whose ids share ``floor(id / BLOCK)``,
the first after the last. If there is no other or it ends alike, the pair has
no difference: all of it is prompt, the completions are empty.

Contract: a turn is (conversation, turn number, role, text); null roles and
texts are empty. Rows equal in all of that are one. Other rows that repeat a
turn number belong to the same turn, by role and text, and two sides share the
turn if they have the same rows. A pair of one side only has an empty prompt
and one completion. Turns with a null conversation or turn number are left out;
so are rows with a side that is none of ``chosen``, ``rejected`` and ``both``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"
LEARNED = "assistant"
PART_TURNS, BLOCK = 64, 64


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def body(text: Column) -> Column:
    return F.concat(text, F.lit("\n" + END + "\n"))


def rendered(turns: Column) -> Column:
    """``<|role|>`` and the text, each on lines of their own, then the end mark, for each turn of an array."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), body(t["text"]))), "")


def loss_spans(turns: Column) -> Column:
    """``start:end`` of what carries loss in ``rendered(turns)``, comma-joined; code points, end exclusive."""

    def step(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.length(header(t["role"]))
        end = start + F.length(body(t["text"]))
        span = F.concat(F.when(so_far["spans"] == "", "").otherwise(","), start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.when(t["role"] == LEARNED, span).otherwise("")).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), step, lambda x: x["spans"])


def part_of(turn: str) -> Column:
    return F.floor(F.col(turn) / PART_TURNS).cast("long")


def format_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, part, n_prompt, prompt, chosen, rejected, chosen_loss, rejected_loss`` from ``pair_id, side, turn, role, text``.

    ``side`` is ``chosen``, ``rejected`` or, for a row that stands on either, ``both``.
    ``n_prompt`` counts the turn rows of the part that are prompt.
    """
    clean = turns.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        F.col("side").cast("string").alias("side"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("pair_id is not null and turn is not null and side in ('chosen', 'rejected', 'both')")
    # Distinct rows of a turn by 128 bits of hash, so that only numbers are shuffled; then a turn is two sums on either side.
    marks = clean.select("pair_id", "side", "turn", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(3), "text", "role").alias("g"))
    rows = marks.groupBy("pair_id", "turn", "h", "g").agg(*[F.bool_or(F.col("side").isin(s, "both")).alias(s) for s in ("chosen", "rejected")])
    turn_sides = rows.groupBy("pair_id", "turn").agg(
        *[F.struct(F.coalesce(F.bit_xor(F.when(F.col(s), F.col("h"))), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.when(F.col(s), F.col("g"))), F.lit(0)).alias("y"), F.count_if(F.col(s)).alias("n")).alias(s) for s in ("chosen", "rejected")]
    )
    part_sides = turn_sides.groupBy("pair_id", part_of("turn").alias("part")).agg(F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("parts_at"))
    first = part_sides.groupBy("pair_id").agg(F.min("parts_at").alias("parts_at"))
    known = part_sides.select("pair_id", "part").join(first, "pair_id")
    prompt = F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))
    segment = F.when(prompt, "prompt").otherwise(F.col("side"))
    # One shuffle of the texts, by pair and part: the aggregate has the join's keys.
    placed = clean.withColumn("part", part_of("turn")).join(known, ["pair_id", "part"]).select("pair_id", "part", segment.alias("segment"), F.struct("turn", "role", "text").alias("t"))
    gathered = placed.groupBy("pair_id", "part").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("segment").isin(*names), F.col("t")))).alias(s) for s, names in (("prompt", ["prompt"]), ("chosen", ["chosen", "both"]), ("rejected", ["rejected", "both"]))]
    )
    return gathered.select(
        "pair_id",
        "part",
        F.size("prompt").alias("n_prompt"),
        *[rendered(F.col(s)).alias(s) for s in ("prompt", "chosen", "rejected")],
        *[loss_spans(F.col(s)).alias(f"{s}_loss") for s in ("chosen", "rejected")],
    )


def paired(conversations: DataFrame) -> DataFrame:
    """``pair_id, side, turn, role, text``: every conversation and its copy with another last answer (see above)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("pair_id is not null and turn is not null")
    # The last answer of each conversation: of several rows in that turn the one with the largest text.
    last = turns.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    block = F.floor(F.col("pair_id") / BLOCK)
    order = Window.partitionBy(block).orderBy("pair_id")  # at most BLOCK conversations
    whole = Window.partitionBy(block).orderBy("pair_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_turns = turns.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max("turn").alias("last_turn"))
    answers = last.select("pair_id", F.col("last.turn").alias("last_turn"), F.coalesce(F.lead("last.text").over(order), F.first("last.text").over(whole)).alias("text"))
    part = part_of("turn").alias("part")
    # Each conversation's last answer is told to all parts that it has, so that a long conversation is not one key.
    parts = turns.select("pair_id", part).distinct().join(last_turns, "pair_id", "left")
    kept = turns.withColumn("part", part).join(parts, ["pair_id", "part"])
    replaced = (F.col("role") == LEARNED) & (F.col("turn") == F.col("last_turn"))
    own = kept.select("pair_id", F.when(replaced, "chosen").otherwise("both").alias("side"), "turn", "role", "text")
    return own.union(answers.select("pair_id", F.lit("rejected"), "last_turn", F.lit(LEARNED), "text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_chat_format``: all of ``conversations``."""
    return format_pairs(paired(common.table(spark, sf_dir, "conversations")))


SQL = r"""
WITH turns AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS pair_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last_turns AS (SELECT pair_id, max(turn) AS turn FROM turns WHERE role = 'assistant' GROUP BY pair_id),
last_answers AS (
  SELECT t.pair_id, t.turn, max(t.text) AS text FROM turns t JOIN last_turns l ON t.pair_id = l.pair_id AND t.turn = l.turn
  WHERE t.role = 'assistant' GROUP BY t.pair_id, t.turn),
others AS (
  SELECT pair_id, turn, coalesce(lead(text) OVER (PARTITION BY floor(pair_id / 64) ORDER BY pair_id),
    first_value(text) OVER (PARTITION BY floor(pair_id / 64) ORDER BY pair_id)) AS text FROM last_answers),
sides AS (
  SELECT t.*, 'chosen' AS side FROM turns t
  UNION SELECT t.*, 'rejected' FROM turns t LEFT JOIN last_turns l ON t.pair_id = l.pair_id
    WHERE NOT (t.role = 'assistant' AND l.turn IS NOT NULL AND t.turn = l.turn)
  UNION SELECT pair_id, turn, 'assistant', text, 'rejected' FROM others),
compared AS (
  SELECT pair_id, turn,
    list({'r': role, 't': text} ORDER BY role, text) FILTER (WHERE side = 'chosen') AS c,
    list({'r': role, 't': text} ORDER BY role, text) FILTER (WHERE side = 'rejected') AS r
  FROM sides GROUP BY pair_id, turn),
parted AS (SELECT pair_id, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) AS parts_at FROM compared GROUP BY pair_id),
placed AS (
  SELECT DISTINCT s.pair_id, CAST(floor(s.turn / 64) AS BIGINT) AS part, s.turn, s.role, s.text,
    CASE WHEN parts_at IS NULL OR s.turn < parts_at THEN 'prompt' ELSE side END AS segment,
    '<|' || s.role || '|>' || chr(10) AS head, s.text || chr(10) || '<|end|>' || chr(10) AS body
  FROM sides s JOIN parted p ON s.pair_id = p.pair_id),
spans AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, segment ORDER BY turn, role, text) AS stop FROM placed)
SELECT pair_id, part, count(*) FILTER (WHERE segment = 'prompt') AS n_prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (WHERE segment = 'prompt'), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (WHERE segment = 'chosen'), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (WHERE segment = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE segment = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE segment = 'rejected' AND role = 'assistant'), '') AS rejected_loss
FROM spans GROUP BY pair_id, part
"""
