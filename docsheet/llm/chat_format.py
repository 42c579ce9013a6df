"""Chat formatting with DataFrame functions only: cumulative snapshots collapse, then conversations are rendered.

A logged conversation that is a prefix of a longer one is dropped, and of equal ones all but that of the least conv_id.
Every turn gets a rolling hash of all turns up to it (128 bits); a conversation is a prefix of another if its last hash
is one of the other's hashes, which an anti-join on distinct hashes finds, so a first turn that many conversations share is
one row there.

Turns are ordered by turn number, then by a digest of role and text. A conversation may be longer than a task can hold:
turns are dealt in ranges, numbered within each range, and ranges of one conversation are chained by their counts and
hashes. Rendered conversations come in parts of at most ``part_turns`` turns.

Exactly repeated rows are one turn. Null roles and texts count as empty; null turn numbers come first; rows without a
conv_id make one conversation. Only the four named columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

KEY = ("conv_id", "turn", "digest")


def _turns(conversations: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = columns
    empty = F.lit("")
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    return rows.withColumn("digest", F.md5(F.concat_ws("\x1f", "role", "text")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, at, h1, h2, length): position from 1, rolling hashes of the prefix that ends there, and turns in all."""
    dealt = turns.select(*KEY).distinct().repartitionByRange(*KEY).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)  # from here on a row's range is fixed
    inside = W.partitionBy("conv_id", "part").orderBy("turn", "digest")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    ranges = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("length"))
    join = lambda x, y: x.join(y.withColumnsRenamed({"conv_id": "_c", "part": "_p"}), _same(F.col("conv_id"), F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")
    at = join(dealt.withColumn("at", F.row_number().over(inside)), ranges).withColumn("at", (F.col("at") + F.col("before")).cast("long")).drop("before")
    hashed = materialise(at.withColumn("h1", F.xxhash64("at", "digest")).withColumn("h2", F.xxhash64("digest", "at", F.lit(1))))
    up_to = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = hashed.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0).cast("long")).alias(f"x{k}") for k in (1, 2)])
    rolled = hashed.withColumns({f"h{k}": F.bit_xor(f"h{k}").over(up_to) for k in (1, 2)})
    out = join(rolled, sums)
    return out.select(*KEY, "at", *[F.col(f"h{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"h{k}") for k in (1, 2)], "length")


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that are neither a prefix of a longer one nor equal to one of a lesser id."""
    whole = rolled.where(F.col("at") == F.col("length")).groupBy("length", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = rolled.where(F.col("at") < F.col("length")).select(F.col("at").alias("length"), "h1", "h2").distinct()
    return whole.join(inner, ["length", "h1", "h2"], "left_anti").select("conv_id")


def render(role: Column, text: Column) -> Column:
    """One turn between its marks."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame, part_turns: int = 64, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per part of a maximal conversation: conv_id, part (from 0), n_turns of the conversation, part_turns and rendered text."""
    turns = _turns(conversations, columns)
    rolled = materialise(prefixes(turns))
    chosen = maximal(rolled).withColumnRenamed("conv_id", "_c")
    placed = rolled.join(chosen, _same(F.col("conv_id"), F.col("_c")), "left_semi").select(*[F.col(c).alias(f"_{c}") for c in KEY], "at", "length")
    texts = turns.join(placed, _same(F.col("conv_id"), F.col("_conv_id")) & _same(F.col("turn"), F.col("_turn")) & (F.col("digest") == F.col("_digest")))
    one = F.struct("at", render(F.col("role"), F.col("text")).alias("rendered"))
    part = F.floor((F.col("at") - 1) / part_turns).cast("long").alias("part")
    parts = texts.groupBy("conv_id", part).agg(F.first("length").alias("n_turns"), F.collect_set(one).alias("turns"))  # a set: repeated rows are one turn
    joined = F.array_join(F.transform(F.array_sort("turns"), lambda t: t["rendered"]), "")
    return parts.select("conv_id", "part", "n_turns", F.size("turns").cast("long").alias("part_turns"), joined.alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS digest FROM conversations
), placed AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS length,
         md5(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)) AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest)
), whole AS (
  SELECT min(conv_id) AS conv_id, length, prefix FROM placed WHERE pos = length GROUP BY length, prefix
), chosen AS (
  SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.prefix = whole.prefix AND p.length > whole.length)
)
SELECT p.conv_id, (p.pos - 1) // 64 AS part, max(p.length) AS n_turns, count(*) AS part_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed p JOIN chosen c ON p.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1, 2
"""
