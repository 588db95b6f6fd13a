"""Chat formatting (operator 5): multi-party perspective rotation, one rendering for every participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation whose offsets one task sums.
TURNS_TOGETHER = 1024


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, seq, turn, segment, seg_start, mask_start, mask_end: the dialogue once for every participant.

    In a participant's perspective that speaker's turns read "<|assistant|>\\n...<|end|>\\n" and everybody else's
    "<|user:name|>\\n...<|end|>\\n". Joined in the order of seq, the segments are the whole dialogue; seg_start is a segment's
    place in it, and [mask_start, mask_end) the characters to train on: the assistant's words and the end mark after them
    (equal numbers: none). Turns come in the order of turn (null last), role, text. Null texts are empty; a null role is the
    participant "unknown"; rows without a conv_id form one conversation. Repeated rows are turns of their own. An empty
    table gives no rows; other columns are ignored.

    A dialogue is never gathered: rows are rendered where they are, and offsets are summed in two levels, within groups of
    turns and over groups, so that a conversation of any length is shared out.
    """
    conv, role = F.col(conv_col).cast("long"), F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(
        conv.alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit((1 << 53) - 1)) / TURNS_TOGETHER))
    who = rows.groupBy(F.col("conv_id").alias("own_conv"), F.col("role").alias("perspective")).agg(F.lit(1).alias("one")).drop("one")
    views = rows.join(who, F.col("conv_id").eqNullSafe(F.col("own_conv"))).drop("own_conv")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n")))
    views = views.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit("<|end|>\n")))
    views = views.withColumn("len", F.length("segment").cast("long"))
    sums = views.groupBy("conv_id", "perspective", "part").agg(F.sum("len").alias("chars"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("g"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
    )
    order = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = views.withColumn("seq0", F.row_number().over(order) - 1).withColumn("start0", F.coalesce(F.sum("len").over(upto), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("g"))
    start = F.col("start0") + F.col("chars0")
    return placed.join(sums, same).select(
        "conv_id",
        "perspective",
        (F.col("seq0") + F.col("rows0")).alias("seq"),
        "turn",
        "segment",
        start.alias("seg_start"),
        F.when(own, start + F.col("head")).otherwise(start).alias("mask_start"),
        F.when(own, start + F.col("len") - 1).otherwise(start).alias("mask_end"),
    )


ROTATE_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), who AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
v AS (
  SELECT t.conv_id, perspective, turn, role, text, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || role || '|>' || chr(10) END AS head
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id
), s AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment,
         row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text) - 1 AS seq
  FROM v
), p AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM s
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, segment, CAST(pos AS BIGINT) AS seg_start,
       CAST(CASE WHEN own THEN pos + length(head) ELSE pos END AS BIGINT) AS mask_start,
       CAST(CASE WHEN own THEN pos + length(segment) - 1 ELSE pos END AS BIGINT) AS mask_end
FROM p
"""
