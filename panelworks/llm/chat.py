"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A logger that writes a conversation after every turn leaves logs that are
prefixes of longer ones. Each turn gets the rolling hash of its conversation up
to itself: the sum of the hashes of (position, role, text), twice and
independently. A log whose whole hash is the hash of a proper prefix of another
one is anti-joined away; of equal logs the smallest id stays.

No conversation is ordered in one task: turns are range-partitioned by
(conversation, turn) and stored in that order, each with a number that grows along
it. Numbering, hashing and the search for maximal logs work on these numbers and on
64-bit digests of the turns; the texts are read again only to render what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.ordered import null_safe_join
from panelworks.session import materialise

PART_TURNS = 64
MOST_BROADCAST = 200_000  # parts of conversations, some 50 bytes each
PLACE = ["named", "conv", "place"]  # a conversation's turns in one partition; a null id is the conversation that is not named


def stored_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place, rid and digests of every turn, stored in order: ``rid`` grows along it within a place."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(placed.select(
        F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "role", "text",
        F.spark_partition_id().alias("place"), F.monotonically_increasing_id().alias("rid"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2")), "chat-turns")


def parts_of(stored: DataFrame) -> DataFrame:
    """Per conversation and place: its turns there, the first one's number, the turns before it and in all."""
    between = Window.partitionBy("named", "conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("named", "conv")
    sizes = stored.groupBy(*PLACE).agg(F.count("*").alias("size"), F.min("rid").alias("first"))
    return materialise(sizes.select(
        *PLACE, "first", F.coalesce(F.sum("size").over(between), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n")), "chat-parts")


def prefixes(stored: DataFrame, parts: DataFrame) -> DataFrame:
    """named, conv, idx (from 1), n and the prefix hashes h1, h2 of every turn, stored; no text is moved."""
    index = F.col("before") + F.col("rid") - F.col("first") + 1
    numbered = stored.select(*PLACE, "rid", "t1", "t2").join(parts, PLACE).withColumn("idx", index)
    exact = "decimal(20,0)"
    hashed = numbered.select(*PLACE, "idx", "n", F.xxhash64("idx", "t1").cast(exact).alias("x1"), F.xxhash64("t2", F.lit(1), "idx").cast(exact).alias("x2"))
    upto = Window.partitionBy(*PLACE).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = materialise(hashed.select(
        *PLACE, "idx", "n", *[F.sum(f"x{i}").over(upto).cast("decimal(38,0)").alias(f"r{i}") for i in (1, 2)]), "chat-hashes")
    # the last sum of a part is the part's; what comes before a part is the sum of the earlier ones
    between = Window.partitionBy("named", "conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = rolled.groupBy(*PLACE).agg(*[F.max_by(f"r{i}", "idx").alias(f"s{i}") for i in (1, 2)])
    sums = ends.select(*PLACE, *[F.coalesce(F.sum(f"s{i}").over(between), F.lit(0)).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)])
    return materialise(rolled.join(sums, PLACE).select(
        "named", "conv", "idx", "n", *[(F.col(f"b{i}") + F.col(f"r{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)]), "chat-prefixes")


def maximal(numbered: DataFrame) -> DataFrame:
    """conv_id and n_copies (equal logs, itself included) of the logs that no longer one continues."""
    whole = ["idx", "h1", "h2"]
    logs = numbered.where("idx = n").select(F.expr("if(named, conv, null)").alias("conv_id"), *whole)
    longer = numbered.where("idx < n").groupBy(*whole).agg(F.lit(1).alias("one")).drop("one")
    alone = logs.join(longer, whole, "left_anti")
    return alone.groupBy(*whole).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")).select("conv_id", "n_copies")


def render(turns: DataFrame, part_turns: int = PART_TURNS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """conv_id, part, n_turns, rendered and n_copies of every maximal conversation.

    A part holds up to ``part_turns`` turns; a conversation's text is its parts
    in order, so none is ever put together in one task. Turns are ordered by
    (turn, role, text), nulls first; a null role or text is empty, repeated
    turns repeat, and turns without a conv_id are one conversation of their own
    (named null; of equal logs a named one stays). An empty table gives an empty
    result. Only conv_id, turn, role and text are read. The places of what stays
    are broadcast up to ``most_broadcast`` rows and joined by a shuffle beyond.
    """
    stored = stored_turns(turns)
    parts = parts_of(stored)
    left = maximal(prefixes(stored, parts))
    spans = parts.withColumn("conv_id", F.expr("if(named, conv, null)"))
    spans = materialise(null_safe_join(spans, left, ["conv_id"]).select(*PLACE, "conv_id", "first", "before", "n_copies"), "chat-kept")
    if spans.count() <= most_broadcast:
        spans = F.broadcast(spans)
    index = F.col("before") + F.col("rid") - F.col("first") + 1
    kept = stored.select(*PLACE, "rid", "role", "text").join(spans, PLACE).withColumn("idx", index)
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    lines = kept.select("conv_id", F.floor((F.col("idx") - 1) / part_turns).alias("part"), "idx", line.alias("line"), "n_copies")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]))
    return lines.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_turns"), joined.alias("rendered"), F.max("n_copies").alias("n_copies"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({{'role': role, 'text': text}} ORDER BY idx) AS turns FROM t GROUP BY conv_id),
alone AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS o WHERE o.turns[1] = c.turns[1] AND o.n > c.n AND o.turns[1:c.n] = c.turns)),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM alone GROUP BY turns)
SELECT kept.conv_id, (t.idx - 1) // {PART_TURNS} AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY idx) AS rendered,
  max(n_copies) AS n_copies
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY kept.conv_id, (t.idx - 1) // {PART_TURNS}
"""
