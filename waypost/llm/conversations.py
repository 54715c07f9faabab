"""Chat formatting with cumulative-snapshot collapse.

Logs of chats often hold a conversation several times, each time with a few more
turns.  Every turn gets the rolling hash of the turns up to it (two 64-bit
sums of hashes of place, role and text).  A conversation whose last rolling hash and
length are found inside a longer one is a snapshot of it: an anti-join drops it.
Of equal conversations the one of the lowest id stays.  Only what is left is
rendered, so its texts alone are grouped.

Only DataFrame operations.  Rolling hashes of popular openings are grouped
before they are joined, so they don't gather in one task.  What is in one task is a
conversation, which one row has to hold in the end.

Defined cases: a turn without a conversation id is a conversation of its own, equal ones
being copies of each other, which stand behind conversations with an id;
turns go by number, null first, and turns of one number by the MD5 of role and text, repeated
turns included; a null role is rendered as ``unknown``, a null text as empty, but
neither equals these in the hashes; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_hash(seed: int, *more: Column) -> Column:
    told = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(F.lit(seed), *more, *told)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, tie, h1, h2, role, text, copies); conv is never null, and a conversation without id has ``copies``."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    told = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c)))
    tie = F.unhex(F.md5(F.concat(told("role"), F.lit("\n"), told("text"))))
    hashed = rows.withColumns({"h1": turn_hash(1), "h2": turn_hash(2), "tie": tie})
    named = hashed.where("conv_id IS NOT NULL").select(F.concat(F.lit("id "), F.col("conv_id").cast("string")).alias("conv"), "conv_id", "turn", "tie", "h1", "h2", "role", "text", F.lit(1).cast("long").alias("copies"))
    alone = hashed.where("conv_id IS NULL").groupBy("h1", "h2").agg(F.min("turn").alias("turn"), F.min("tie").alias("tie"), F.min("role").alias("role"), F.min("text").alias("text"), F.count("*").alias("copies"))
    conv = F.concat_ws(" ", F.lit("alone"), F.hex("h1"), F.hex("h2"))
    return named.union(alone.select(conv, F.lit(None).cast(rows.schema["conv_id"].dataType), "turn", "tie", "h1", "h2", "role", "text", "copies"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of conversations that are no snapshot of a longer one."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "tie", "h1", "h2")
    placed = turns.select("conv", "conv_id", "copies", "turn", "tie", "h1", "h2", F.row_number().over(order).alias("nth"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rolling = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "nth", "h1", "h2")).over(so_far)
    prefixes = shared.written(placed.select("conv", "conv_id", "copies", "nth", rolling(3).alias("p1"), rolling(4).alias("p2")), "prefixes")
    last = prefixes.groupBy("conv").agg(F.max("nth").alias("nth"), F.max_by("p1", "nth").alias("p1"), F.max_by("p2", "nth").alias("p2"), F.max("conv_id").alias("conv_id"), F.max("copies").alias("copies"))
    ends = shared.written(last, "ends")
    inner = prefixes.join(ends.select("conv", F.col("nth").alias("n")), "conv").where("nth < n").select("nth", "p1", "p2").distinct()
    kept = ends.groupBy("nth", "p1", "p2").agg(F.min_by("conv", F.struct(F.col("conv_id").isNull(), "conv_id", "conv")).alias("conv"), F.sum("copies").alias("n_copies"))
    return kept.join(shared.written(inner, "inner"), ["nth", "p1", "p2"], "left_anti").select("conv", F.col("nth").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the conversations in ``kept``."""
    turn = F.struct(F.col("turn"), "tie", "h1", "h2", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_conv = turns.join(shared.written(kept, "kept"), "conv").groupBy("conv", "conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))
    return by_conv.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    turns = turns_of(conversations)
    return render(turns, maximal(turns))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal ``conversations``, rendered."""
    return format_chats(shared.table(spark, sf_dir, "conversations"))


ORACLE = """
WITH marked AS (
  SELECT conv_id, turn, role, text, coalesce('id ' || conv_id, 'alone ' || row_number() OVER ()) AS conv,
         md5(CASE WHEN role IS NULL THEN '0' ELSE '1' || role END || chr(10) || CASE WHEN text IS NULL THEN '0' ELSE '1' || text END) AS tie
  FROM conversations),
told AS (
  SELECT conv, conv_id, role, text, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv) AS n,
         list({'role': role, 'text': text}) OVER w AS so_far
  FROM marked WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, tie ROWS UNBOUNDED PRECEDING)),
kept AS (
  SELECT min(conv_id) AS conv_id, first(conv ORDER BY conv_id NULLS LAST) AS conv, n, count(*) AS n_copies FROM told WHERE nth = n
  AND NOT EXISTS (SELECT 1 FROM told AS longer WHERE longer.nth < longer.n AND longer.so_far = told.so_far)
  GROUP BY so_far, n)
SELECT kept.conv_id, kept.n AS n_turns, kept.n_copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY nth) AS text
FROM kept JOIN told ON kept.conv = told.conv GROUP BY kept.conv, kept.conv_id, kept.n, kept.n_copies
"""
