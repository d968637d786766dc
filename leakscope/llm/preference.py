"""Preference formatting: chosen and rejected conversations with a shared prompt and masked completions.

The result is one row for each rendered turn, not one for each pair, so a
conversation of any length is never gathered in one row.  The rows of a pair and part,
joined in the order of ``pos``, are the prompt (once) and the two completions; ``start``
is the place of the turn's first character in that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The chat markup.
OPEN, BODY, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(side: DataFrame, name: str, pair: str) -> DataFrame:
    """Turns with their place in the conversation; null texts are empty, null roles ``unknown``."""
    rows = side.select(
        F.col(pair).alias("pair_id"), F.lit(name).alias("side"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.where("pair_id is not null")


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """Rendered turns ``(pair id, part, pos, role, rendered, start, train_start, train_end)``.

    ``chosen`` and ``rejected`` have the pair id, ``turn``, ``role`` and ``text``.  Turns are put in the
    order of (turn, role, text).  The prompt is the longest common prefix of equal turns; the rest of each
    side is its completion.  ``train_start`` and ``train_end`` bound the characters of a completion that
    the loss counts: text and end mark of ``trained_role``; null for all else and for the prompt.  Pairs that
    are equal, or one of which goes no further, have no rows for that completion.  A pair on one
    side only has no prompt.  Rows without a pair id are left out; repeated turns stay.
    """
    turns = _turns(chosen, "chosen", pair).unionByName(_turns(rejected, "rejected", pair))
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(order))
    mark = F.sha1(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    places = turns.select("pair_id", "side", "pos", mark.alias("mark")).groupBy("pair_id", "pos").agg(
        F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b")
    )
    split = places.groupBy("pair_id").agg(F.min(F.when((F.col("n") < 2) | (F.col("a") != F.col("b")), F.col("pos"))).alias("split"))
    parts = turns.join(split, "pair_id").withColumn("common", F.col("split").isNull() | (F.col("pos") < F.col("split")))
    parts = parts.where("not common or side = 'chosen'").withColumn("part", F.when(F.col("common"), "prompt").otherwise(F.col("side")))
    head = F.concat(F.lit(OPEN), "role", F.lit(BODY))
    parts = parts.withColumn("rendered", F.concat(head, "text", F.lit(CLOSE)))
    before = Window.partitionBy("pair_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long")))
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return parts.select(
        F.col("pair_id").alias(pair), "part", "pos", "role", "rendered", "start",
        F.when(trained, F.col("start") + F.length(head)).alias("train_start"),
        F.when(trained, F.col("start") + F.length("rendered")).alias("train_end"),
    )


def shortened_answers(conversations: DataFrame) -> DataFrame:
    """The conversations with the last assistant turn cut to its first half: the rejected side of the query.

    Last means the greatest (turn, text); of repeated such rows each is cut.
    """
    of = Window.partitionBy("conv_id")
    place = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("last", F.max(place).over(of))
    half = F.expr("substr(text, 1, length(text) div 2)")
    return rows.select("conv_id", "turn", "role", F.when(place == F.col("last"), half).otherwise(F.col("text")).alias("text"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1 AS last
  FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN last THEN substr(text, 1, length(text) // 2) ELSE text END FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS pos FROM u),
d AS (SELECT c.conv_id, min(c.pos) AS split FROM v c JOIN v r ON c.conv_id = r.conv_id AND c.pos = r.pos
  WHERE c.side = 'chosen' AND r.side = 'rejected' AND (c.text <> r.text OR c.role <> r.role) GROUP BY 1),
p AS (SELECT v.conv_id, CASE WHEN split IS NULL OR pos < split THEN 'prompt' ELSE side END AS part, side, pos, role,
    '{OPEN}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, length(role) + 5 AS head
  FROM v LEFT JOIN d USING (conv_id)),
s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM p WHERE part <> 'prompt' OR side = 'chosen')
SELECT conv_id, part, pos::INT AS pos, role, rendered, start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + head END AS train_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) END AS train_end
FROM s
"""
