"""Chat formatting: multi-party perspective rotation, DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant
and the others as named users; the mask gives the character spans that are trained on.

Conversations come as rows (conv_id, turn, role, text), in order of turn, role and text. Only a conversation of more than
`max_rows` rows, which no task could hold at some size, is rendered in parts, consecutive runs of `max_rows` rows.

Cases: null role is the participant "unknown"; null text is empty; a null turn sorts first;
a null conv_id is one conversation of its own; repeated rows stand as often as they do in the table; control characters
in a role are one space, so that no role makes a line, and "<|" is broken up in roles and texts, so that neither makes a turn;
"system" is never a participant, but stays in every rendering, and a
conversation of system turns alone gives no row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(role: Column, perspective: Column) -> Column:
    return F.when(role == perspective, F.lit("assistant")).when(role == "system", role).otherwise(F.concat(F.lit("user name="), role))


def _escaped(text: Column) -> Column:
    """Control marks in a text must not read as turns."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _role(role: Column) -> Column:
    return _escaped(F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\x00-\x1F\x7F]+", " "))


def dialogues(conversations: DataFrame, max_rows: int = 4096) -> DataFrame:
    """(conv_id, part, messages): the sorted messages of each part of a conversation. Equal rows travel once, with their number."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("role")).alias("role"), _escaped(F.coalesce("text", F.lit(""))).alias("text"))
    # A table of its own: sizes are counted on it, and its joins stand on plain shuffles, whose hot keys can be split.
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "messages")
    long = written(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter(F.col("n") > max_rows).select(F.col("conv_id").alias("long_id")), "long")
    out = rows.withColumn("part", F.lit(0).cast("long"))
    if not long.isEmpty():
        among = F.col("conv_id").eqNullSafe(F.col("long_id"))
        out = out.join(long, among, "left_anti").unionByName(_in_runs(rows.join(long, among, "left_semi"), max_rows))
    # In order of turn, role and text, as the struct has them; equal messages next to one another.
    gathered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies")))
    repeated = F.transform(gathered, lambda x: F.array_repeat(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")), x["copies"].cast("int")))
    return out.groupBy("conv_id", "part").agg(F.flatten(repeated).alias("messages"))


def _in_runs(rows: DataFrame, max_rows: int) -> DataFrame:
    """rows with `part`, the run of max_rows rows of its conversation, a row of many copies in as many parts as it reaches over. Rows are summed within ranges and the ranges added up, so no task sorts a whole conversation."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("conv_id", "range").agg(F.sum("copies").alias("n"))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(earlier.partitionBy("conv_id").orderBy("range")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("copies").over(earlier.partitionBy("conv_id", "range").orderBy("turn", "role", "text")), F.lit(0))
    placed = ranged.withColumn("within", within).join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range"))).withColumn("at", F.col("base") + F.col("within"))
    last = F.col("at") + F.col("copies")
    parts = placed.withColumn("last", last).withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / max_rows), F.floor((last - 1) / max_rows))))
    own = F.least(F.col("last"), (F.col("part") + 1) * max_rows) - F.greatest(F.col("at"), F.col("part") * max_rows)
    return parts.select(*order, own.cast("long").alias("copies"), F.col("part").cast("long").alias("part"))


def rotate(conversations: DataFrame, max_rows: int = 4096) -> DataFrame:
    """One row per conversation (part) and participant: conv_id, part, perspective, n_messages, n_trained, n_chars, trained_chars, mask (spans "start-end", comma-joined), text."""
    people = conversations.select(F.col("conv_id").alias("of"), _role(F.col("role")).alias("perspective")).filter(F.col("perspective") != "system").distinct()
    m, p = F.col("messages"), F.col("perspective")
    body = lambda x: F.concat(x["text"], F.lit(CLOSE))
    head = lambda x: F.concat(F.lit(OPEN), _header(x["role"], p), F.lit("\n"))
    pieces = F.transform(m, lambda x: F.struct(F.length(head(x)).alias("h"), F.length(body(x)).alias("b"), (x["role"] == p).alias("t")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["h"] + x["b"] + 1).alias("at"),
        F.when(x["t"], F.concat(acc["mask"], F.when(acc["mask"] == "", F.lit("")).otherwise(F.lit(",")), (acc["at"] + x["h"]).cast("string"), F.lit("-"), (acc["at"] + x["h"] + x["b"]).cast("string"))).otherwise(acc["mask"]).alias("mask"),
        (acc["trained"] + F.when(x["t"], x["b"]).otherwise(0)).alias("trained"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"), F.lit(0).alias("trained"))
    return (
        dialogues(conversations, max_rows)
        .join(people, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumn("walk", F.aggregate(pieces, zero, step))
        .select(
            "conv_id", "part", "perspective",
            F.size(m).cast("long").alias("n_messages"),
            F.size(F.filter(m, lambda x: x["role"] == p)).cast("long").alias("n_trained"),
            F.col("walk.at").cast("long").alias("n_chars"),
            F.col("walk.trained").cast("long").alias("trained_chars"),
            F.col("walk.mask").alias("mask"),
            F.concat_ws("", F.transform(m, lambda x: F.concat(head(x), body(x), F.lit("\n")))).alias("text"),
        )
    )


#: rotate() with its defaults.
ROTATE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
    replace(regexp_replace(coalesce(role, 'unknown'), '[\x00-\x1F\x7F]+', ' ', 'g'), '<|', '< |') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth FROM rows_),
people AS (SELECT DISTINCT conv_id AS of_, role AS perspective FROM rows_ WHERE role <> 'system'),
pieces AS (
  SELECT n.*, CAST(nth // 4096 AS BIGINT) AS part, p.perspective, n.role = p.perspective AS t,
    '<|im_start|>' || CASE WHEN n.role = p.perspective THEN 'assistant' WHEN n.role = 'system' THEN n.role
      ELSE 'user name=' || n.role END || chr(10) AS head,
    n.text || '<|im_end|>' AS body
  FROM numbered n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.of_),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, part, perspective ORDER BY nth
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
  FROM pieces)
SELECT conv_id, part, perspective,
  CAST(count(*) AS BIGINT) AS n_messages,
  CAST(count(*) FILTER (WHERE t) AS BIGINT) AS n_trained,
  CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(length(body)) FILTER (WHERE t), 0) AS BIGINT) AS trained_chars,
  coalesce(string_agg(CAST(at_ + length(head) AS BIGINT) || '-' || CAST(at_ + length(head) + length(body) AS BIGINT), ','
    ORDER BY nth) FILTER (WHERE t), '') AS mask,
  string_agg(head || body || chr(10), '' ORDER BY nth) AS text
FROM placed GROUP BY conv_id, part, perspective
"""
