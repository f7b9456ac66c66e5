"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered.

A log often holds a conversation again after each turn. Turns get a rolling prefix hash: the sum of the
hashes of (rank, role, text) so far, in three lanes of 40 bits. A conversation whose whole hash is the
hash of a shorter prefix of another one is left out by an anti-join; of equal conversations the smallest
conv_id stays. Only DataFrame operations are used; a conversation of any length, and any number of rows of one turn
number, is cut into chunks of about CHUNK rows for its windows, and rendered in parts of that many turns, so no task has to
hold all of it. Hashes stand for the texts until the end, where the texts of the conversations that stay are joined once.

Defined results: rows without conv_id or turn belong to no conversation and are left out; null role and null text
count as empty; equal rows count once; rows of one turn with different contents are ordered by the md5 of role and text;
empty texts are rendered as empty turns; an empty table gives an empty result; columns other than the named ones are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import spread_join, stage

#: Turns in one chunk; and lanes of the rolling hash, each a sum of 40-bit hashes, which fits 2**22 turns and more.
CHUNK, LANES = 256, ("h0", "h1", "h2")


def _turns(chat: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, key, role, text) of the rows that belong to a conversation; key is the md5 of role and text."""
    rows = chat.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", key.alias("key"), "role", "text")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, key, copies, rank, h0, h1, h2): the rolling hashes up to each turn. Texts stay where they are."""
    rows = turns.groupBy("conv_id", "turn", "key").agg(F.count("*").alias("copies")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    rows = stage(rows, "keys")
    # a chunk has CHUNK turn numbers; one with more rows is cut further, by turn and by ranges of keys
    sizes = stage(rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "sizes")
    first = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long")
    slot = (F.col("turn") - F.col("chunk") * CHUNK) * (1 << 40) + F.floor(first * F.ceil(F.col("n") / CHUNK) / (1 << 32))
    rows = spread_join(rows, sizes, ["conv_id", "chunk"], "n", "left").withColumn("cut", F.coalesce(slot, F.lit(0)).cast("long")).drop("n")
    part = ["conv_id", "chunk", "cut"]
    order = Window.partitionBy(*part).orderBy("turn", "key")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    # ranks run on over parts: the turns in earlier parts come first
    earlier = Window.partitionBy("conv_id").orderBy("chunk", "cut").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n")).select(*part, before("n").alias("before"))
    rows = rows.join(sizes, part).withColumn("rank", F.col("place") + F.col("before"))
    lanes = {h: F.pmod(F.xxhash64(F.lit(k), "rank", "key"), F.lit(1 << 40)) for k, h in enumerate(LANES)}
    rows = stage(rows.withColumns(lanes).drop("before"), "turns")
    sums = rows.groupBy(*part).agg(*(F.sum(h).alias(h) for h in LANES))
    sums = sums.select(*part, *(before(h).alias(f"{h}_before") for h in LANES))
    so_far = Window.partitionBy(*part).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*part, "turn", "key", "copies", "rank", *(F.sum(h).over(so_far).alias(h) for h in LANES)).join(sums, part)
    return rows.select("conv_id", "turn", "key", "copies", "rank", *((F.col(h) + F.col(f"{h}_before")).alias(h) for h in LANES))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another, and the smallest of equal ones."""
    ends = stage(prefixes.groupBy("conv_id").agg(F.max("rank").alias("rank"), *(F.max_by(h, "rank").alias(h) for h in LANES)), "ends")
    key = ["rank", *LANES]
    distinct = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    last = ends.select("conv_id", F.col("rank").alias("n_turns"))
    proper = spread_join(prefixes.select("conv_id", *key), last, ["conv_id"], "n_turns").where("rank < n_turns").select(*key).distinct()
    return distinct.join(proper, key, "left_anti").select("conv_id", F.col("rank").alias("n_turns"), "n_copies")


def format_chats(chat: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id long, n_turns long, n_copies long, part long, rendered string: the maximal conversations, rendered turn by turn
    as opening role newline text closing newline; parts (from 0) of up to CHUNK turns follow each other."""
    turns = _turns(chat, conv_col, turn_col, role_col, text_col)
    prefixes = stage(_prefixes(turns), "prefixes")
    kept = stage(maximal_conversations(prefixes), "maximal")
    ranks = stage(spread_join(prefixes.select("conv_id", "turn", "key", "copies", "rank"), kept, ["conv_id"], "n_turns"), "ranks")
    line = F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(f"{closing}\n"))
    lines = spread_join(turns, ranks, ["conv_id", "turn", "key"], "copies").select("conv_id", "n_turns", "n_copies", F.floor((F.col("rank") - 1) / CHUNK).alias("part"), F.struct("rank", line.alias("line")).alias("turn"))
    # copies of a row have one rank, and a set holds them once
    parts = lines.groupBy("conv_id", "n_turns", "n_copies", "part").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    return parts.select("conv_id", "n_turns", "n_copies", "part", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("rendered"))
