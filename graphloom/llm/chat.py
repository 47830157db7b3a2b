"""Preference formatting of conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is
rendered once, as the prompt; what follows on each side is that side's completion, with a mask that marks the
code points to train on: the text and end mark of assistant turns. Role headers and other roles' turns in a
completion are context and stay unmarked.

One shuffle brings the turns of a pair together, the unit of the result: a row holds both conversations.

Defined results: null text = empty text; null role = ``unknown``; turns go by turn number (null first), then
role, then text, so ties and repeated rows have one order and are all kept; rows without a conversation id
belong to none and are left out; a pair with one side missing gets null for that side and an empty prompt;
equal conversations get empty completions; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _mask(turns: Column) -> Column:
    """start:end of the code points to train on, comma-joined."""

    before = running(F.transform(turns, lambda t: F.length(_rendered(t))), lambda a, b: a + b)

    def span(turn: Column, at: Column) -> Column:
        start = at + F.length(turn["role"]) + F.lit(len(HEAD + MIDDLE))
        return F.when(turn["role"] == TRAINED, F.concat_ws(":", start, start + F.length(turn["text"]) + F.lit(len(END))))

    return F.array_join(F.zip_with(turns, before, span), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen boolean, conv_id, turn, role, text) -> one row per pair.

    pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda chosen: F.sort_array(F.collect_list(F.when(F.col("chosen") == chosen, turn)))
    both = turns.groupBy("pair_id").agg(
        F.max(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"),
        side(True).alias("c"),
        side(False).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    both = both.withColumn("same", same)
    both = both.withColumn("k", F.when(F.array_position("same", False) > 0, F.array_position("same", False) - 1).otherwise(F.size("same")).cast("int"))
    rest = lambda name: F.slice(name, F.col("k") + 1, F.greatest(F.size(name) - F.col("k"), F.lit(0)))
    both = both.withColumns({"prompt_part": F.slice("c", 1, F.col("k")), "c_part": rest("c"), "r_part": rest("r")})
    text = lambda name: F.array_join(F.transform(name, _rendered), "")
    have = lambda key, value: F.when(F.col(key).isNotNull(), value)
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("k").cast("bigint").alias("prompt_turns"), text("prompt_part").alias("prompt"),
        have("chosen_id", text("c_part")).alias("chosen"), have("chosen_id", _mask(F.col("c_part"))).alias("chosen_mask"),
        have("rejected_id", text("r_part")).alias("rejected"), have("rejected_id", _mask(F.col("r_part"))).alias("rejected_mask"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences: conversations 2k and 2k + 1 stand for the chosen and the rejected of pair k."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("conv_id").isNotNull())
    side = F.pmod("conv_id", F.lit(2))
    return preference_pairs(turns.select(F.floor((F.col("conv_id") - side) / 2).alias("pair_id"), (side == 0).alias("chosen"), "conv_id", "turn", "role", "text"))


OP2_SQL = r"""
WITH t AS (
  SELECT (conv_id - conv_id % 2) // 2 AS pair_id, conv_id % 2 = 0 AS chosen, conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT pair_id, max(conv_id) FILTER (chosen) AS chosen_id, max(conv_id) FILTER (NOT chosen) AS rejected_id, max(i) AS longest FROM t GROUP BY pair_id
), differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) AS first_i
  FROM (SELECT * FROM t WHERE chosen) c FULL JOIN (SELECT * FROM t WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.i = r.i
  WHERE c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY 1
), k AS (
  SELECT ids.*, coalesce(first_i - 1, longest) AS k FROM ids LEFT JOIN differ USING (pair_id)
), rendered AS (
  SELECT t.*, k.k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM t JOIN k USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(line)) FILTER (i > k) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rendered
), parts AS (
  SELECT pair_id,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (chosen AND i <= k), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (chosen AND i > k), '') AS chosen,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT chosen AND i > k), '') AS rejected,
    coalesce(string_agg((pos + length(role) + 5)::bigint || ':' || (pos + length(line))::bigint, ',' ORDER BY i) FILTER (chosen AND i > k AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((pos + length(role) + 5)::bigint || ':' || (pos + length(line))::bigint, ',' ORDER BY i) FILTER (NOT chosen AND i > k AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY pair_id
)
SELECT pair_id, chosen_id, rejected_id, k AS prompt_turns, prompt,
       CASE WHEN chosen_id IS NOT NULL THEN chosen END AS chosen, CASE WHEN chosen_id IS NOT NULL THEN chosen_mask END AS chosen_mask,
       CASE WHEN rejected_id IS NOT NULL THEN rejected END AS rejected, CASE WHEN rejected_id IS NOT NULL THEN rejected_mask END AS rejected_mask
FROM parts JOIN k USING (pair_id)
"""
