"""Chat formatting for preference pairs.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the prompt; what
follows becomes two completions, masked so that only the assistants' words train. A pair is a row with its prompt, both completions and their
masks; a pair of more than PIECE turns goes on in further rows, so that a conversation of any length is spread over tasks and none is gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED = "assistant"
#: Turn numbers that a row holds.
PIECE = 64


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """The segments of pairs given as turns (pair_id, side, turn, role, text), side 'chosen' or 'rejected'.

    (pair_id, part, turn, role, segment, mask_from, mask_to): part is 'prompt', 'chosen' or 'rejected', turn orders the segments of a
    part, and the characters mask_from to mask_to of a segment train (equal where none does: prompts, other roles than the assistant's).
    The prefix ends at the first turn number that differs or that one side lacks. Null roles and texts count as empty, a null turn as -1;
    of rows that repeat a turn of a side the smallest (role, text) counts; a null pair_id is a pair of its own. A pair with one side
    only has no prompt. Rows of other sides are no part of a pair. An empty table gives no rows; more columns are ignored.
    """
    turn = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = lambda side: F.min(F.when(F.col("side") == side, turn)).alias(side)
    both = turns.filter(F.col("side").isin("chosen", "rejected")).groupBy("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn")).agg(one("chosen"), one("rejected"))
    cuts = both.filter(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy(F.col("pair_id").alias("of")).agg(F.min("turn").alias("cut"))
    cut = both.join(cuts, F.col("pair_id").eqNullSafe(F.col("of")), "left")
    prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(side).alias("said"))
    parts = F.when(prompt, F.array(part("prompt", "chosen"))).otherwise(F.array(part("chosen", "chosen"), part("rejected", "rejected")))
    rows = cut.select("pair_id", "turn", F.inline(F.filter(parts, lambda p: p["said"].isNotNull()))).select("pair_id", "turn", "part", "said.role", "said.text")
    head = (F.length("role") + 5).cast("long")
    trains = (F.col("part") != "prompt") & (F.col("role") == TRAINED)
    return rows.select(
        "pair_id",
        "part",
        "turn",
        "role",
        rendered(F.col("role"), F.col("text")).alias("segment"),
        head.alias("mask_from"),
        F.when(trains, head + F.length("text") + 7).otherwise(head).alias("mask_to"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from turns as preference_segments takes them: (pair_id, piece, prompt, chosen, rejected, chosen_mask, rejected_mask).

    prompt is the common prefix, rendered once, chosen and rejected what follows it on either side, empty where a side has nothing. The masks are
    arrays of (from, to), the characters of the completion that train. Piece k holds the turns from k * PIECE on (turns without a number
    count as -1, so they stand in piece -1); the pieces of a pair, one after the other, are the whole. Nulls, ties and empty tables are as there.
    """
    own = F.struct("turn", "segment", "mask_from", "mask_to")
    lists = [F.collect_list(F.when(F.col("part") == name, own)).alias(name) for name in ("prompt", "chosen", "rejected")]
    piece = F.floor(F.col("turn") / PIECE).cast("long")
    rows = preference_segments(turns).groupBy("pair_id", piece.alias("piece")).agg(*lists)
    said = lambda part: F.array_join(F.transform(F.array_sort(part), lambda t: t["segment"]), "").alias(part)

    def mask(part: str) -> Column:
        span = lambda at, t: F.array(F.struct((at + t["mask_from"]).alias("from"), (at + t["mask_to"]).alias("to")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))
        step = lambda a, t: F.struct(
            (a["at"] + F.length(t["segment"])).alias("at"),
            F.when(t["mask_to"] > t["mask_from"], F.concat(a["spans"], span(a["at"], t))).otherwise(a["spans"]).alias("spans"),
        )
        return F.aggregate(F.array_sort(part), start, step)["spans"].alias(f"{part}_mask")

    return rows.select("pair_id", "piece", said("prompt"), said("chosen"), said("rejected"), mask("chosen"), mask("rejected"))


def with_weaker_reply(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text): the rejected side has its last assistant turn answered by the
    conversation's first assistant turn, or by nothing where that is the same."""
    replies = conversations.filter(F.col("role") == TRAINED).groupBy(F.col("conv_id").alias("of")).agg(
        F.max("turn").alias("last"), F.min("turn").alias("first"), F.min(F.struct("turn", "text"))["text"].alias("early")
    )
    joined = conversations.join(replies, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    swapped = (F.col("role") == TRAINED) & (F.col("turn") == F.col("last"))
    weaker = F.when(swapped, F.when(F.col("first") == F.col("last"), "").otherwise(F.col("early"))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("said")), F.struct(F.lit("rejected").alias("side"), weaker.alias("said")))
    return joined.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.inline(sides)).withColumnRenamed("said", "text")


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their masks as text: from-to, comma-joined."""
    pairs = preference_pairs(with_weaker_reply(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    said = lambda mask: F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ",").alias(mask)
    return pairs.select("pair_id", "piece", "prompt", "chosen", "rejected", said("chosen_mask"), said("rejected_mask"))


ORACLE = f"""
WITH replies AS (
  SELECT conv_id, max(turn) AS last, min(turn) AS first, arg_min(text, turn) AS early
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT c.conv_id AS pair_id, c.turn, c.role, c.text AS chosen,
    CASE WHEN c.role = 'assistant' AND c.turn = r.last THEN CASE WHEN r.first = r.last THEN '' ELSE r.early END ELSE c.text END AS rejected
  FROM conversations c LEFT JOIN replies r ON r.conv_id = c.conv_id),
cuts AS (SELECT pair_id, min(turn) AS cut FROM sides WHERE chosen <> rejected GROUP BY pair_id),
parts AS (
  SELECT pair_id, turn, role, 'prompt' AS part, chosen AS text FROM sides LEFT JOIN cuts USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT pair_id, turn, role, 'chosen', chosen FROM sides JOIN cuts USING (pair_id) WHERE turn >= cut
  UNION ALL SELECT pair_id, turn, role, 'rejected', rejected FROM sides JOIN cuts USING (pair_id) WHERE turn >= cut),
segments AS (
  SELECT *, turn // {PIECE} AS piece, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment, part <> 'prompt' AND role = 'assistant' AS trains FROM parts),
placed AS (
  SELECT *, length(role) + 5 + coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, piece, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM segments)
SELECT pair_id, CAST(piece AS BIGINT) AS piece,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(place AS BIGINT) || '-' || CAST(place + length(text) + 7 AS BIGINT), ',' ORDER BY turn) FILTER (trains AND part = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(CAST(place AS BIGINT) || '-' || CAST(place + length(text) + 7 AS BIGINT), ',' ORDER BY turn) FILTER (trains AND part = 'rejected'), '') AS rejected_mask
FROM placed GROUP BY pair_id, piece
"""
