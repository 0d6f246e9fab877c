"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as ``assistant`` and the others as named users; what the
assistant says, with the end mark, is what a model learns from. System turns belong to no one: they stay system turns in every perspective.

A rendered dialogue is a set of rows, one per turn: its piece, its place from ``start`` to ``end`` (code points) in the whole rendering, and
the span of the loss mask. Joining the pieces in order of ``seq`` gives the whole; nothing gathers a conversation in one
task. Places are running sums, taken within chunks of 2^CHUNK_BITS turn numbers and then over chunks, so a very long conversation is spread too.

Cases: null texts are empty; a null role is the speaker ``unknown``; turns with equal numbers follow in order of role and text, null turns come
first; repeated rows are repeated turns; conversations of system turns only give no rows; conv_id null is a conversation; marks inside texts and roles are
broken up, and line breaks of a role are spaces in its head, so that neither can pass for a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 6
SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, seq, turn, role, piece, is_loss, start, end, loss_start, loss_end: each turn in each perspective."""
    role = F.coalesce("role", F.lit("unknown"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("chunk", F.shiftright(F.col("turn").cast("long"), CHUNK_BITS))  # rounds down, so that turns below 0 are in order; null comes first
    speakers = turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    told = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("role") == F.col("speaker")
    named = F.replace(F.translate("role", "\n\r", "  "), F.lit("<|"), F.lit("< |"))
    head = F.when(F.col("role") == SYSTEM, F.lit("<|im_start|>system\n")).when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), named, F.lit("\n")))
    told = told.withColumns({"head": head, "is_loss": own})
    told = told.withColumn("piece", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("long", F.length("piece").cast("long"))
    dialogue = ["conv_id", "speaker"]
    within = Window.partitionBy(*dialogue, "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    over = Window.partitionBy(*dialogue).orderBy(F.asc_nulls_first("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = told.groupBy(*dialogue, "chunk").agg(F.sum("long").alias("n"), F.count(F.lit(1)).alias("m"))
    chunks = chunks.select(*(F.col(c).alias(f"c_{c}") for c in (*dialogue, "chunk")), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("chars"), F.coalesce(F.sum("m").over(over), F.lit(0)).alias("rows"))
    told = told.withColumns({"to": F.sum("long").over(within.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(within)})
    told = told.join(chunks, F.col("conv_id").eqNullSafe(F.col("c_conv_id")) & (F.col("speaker") == F.col("c_speaker")) & F.col("chunk").eqNullSafe(F.col("c_chunk")))
    start = F.col("chars") + F.col("to") - F.col("long")
    return told.select(
        "conv_id", "speaker", (F.col("rows") + F.col("k") - 1).cast("long").alias("seq"), "turn", "role", "piece", "is_loss", start.alias("start"), (F.col("chars") + F.col("to")).alias("end"),
        F.when(F.col("is_loss"), start + F.length("head")).alias("loss_start"), F.when(F.col("is_loss"), F.col("chars") + F.col("to") - 1).alias("loss_end"),
    )


#: DuckDB's account of the same table.
ROTATE_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
told AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS is_loss,
         CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || replace(translate(t.role, chr(10) || chr(13), '  '), '<|', '< |') || chr(10) END AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
pieces AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM told),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
         CAST(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM pieces WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, seq, turn, role, piece, is_loss, "end" - length(piece) AS start, "end",
       CASE WHEN is_loss THEN "end" - length(piece) + length(head) END AS loss_start, CASE WHEN is_loss THEN "end" - 1 END AS loss_end
FROM placed
"""
