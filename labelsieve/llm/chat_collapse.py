"""Maximal conversations out of cumulative logs.

Chat logs often hold a conversation once for every turn it grew by. A rolling hash over the turns, two words of 64 bits
that take in each turn with its position, names every prefix of every conversation. A conversation whose whole hash is
the hash of a longer one's prefix is dropped by an anti-join; of equal conversations the one with the smallest id stays.
The rest is rendered for training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.operators.ranking import bucketed_rank
from labelsieve.session import materialize

STRETCH = 1024
LAST_TURN = (1 << 62) - 1


def rolling_prefixes(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, role, text, h1, h2): each turn's position and the hash of the turns up to it.

    Long conversations are cut into stretches, inside which positions and hashes run; what lies before a stretch is added
    from its totals, so that one huge conversation is spread over tasks.
    """
    rows = turns.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST_TURN)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    placed = bucketed_rank(rows, ["conv"], F.floor(F.col("turn") / STRETCH), order, "pos").drop("turn")
    placed = placed.withColumn("stretch", F.floor((F.col("pos") - 1) / STRETCH))
    for salt in (1, 2):
        placed = placed.withColumn(f"_t{salt}", F.xxhash64(F.lit(salt), "pos", "role", F.lit(0), "text"))
    placed = materialize(placed)
    totals = placed.groupBy("conv", "stretch").agg(*[F.bit_xor(f"_t{s}").alias(f"_b{s}") for s in (1, 2)])
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = materialize(totals.select("conv", "stretch", *[
        F.coalesce(F.bit_xor(f"_b{s}").over(before), F.lit(0).cast("long")).alias(f"_b{s}") for s in (1, 2)]))
    inside = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select(
        "conv", "stretch", "pos", "role", "text", *[F.bit_xor(f"_t{s}").over(inside).alias(f"_r{s}") for s in (1, 2)])
    return rolled.join(begun, ["conv", "stretch"]).select(
        "conv", "pos", "role", "text", *[F.col(f"_r{s}").bitwiseXOR(F.col(f"_b{s}")).alias(f"h{s}") for s in (1, 2)])


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def collapse(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, n_turns, n_copies, rendered): conversations that are no prefix of another one, rendered in turn order.

    ``n_copies`` counts the equal conversations it stands for. Turns are in the order of their numbers, equal numbers by
    role and text, a null number last; a repeated row is a turn of its own. Null roles and texts are empty. Rows without
    a conversation are left out. Columns other than the four named do not matter.
    """
    prefixes = materialize(rolling_prefixes(turns, conversation, turn, role, text))
    sizes = prefixes.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    whole = materialize(sizes.select("conv", F.col("end.pos").alias("pos"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2")))
    name = ["pos", "h1", "h2"]
    distinct = materialize(whole.groupBy(*name).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies")))
    inner = prefixes.join(whole.select("conv", F.col("pos").alias("n")), "conv").filter("pos < n").select(*name).distinct()
    kept = distinct.join(inner, name, "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_copies")
    lines = prefixes.select("conv", "pos", render_turn(F.col("role"), F.col("text")).alias("line")).join(kept.select("conv"), "conv")
    texts = lines.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines")).select(
        "conv", F.concat_ws("", F.transform("lines", lambda line: line["line"])).alias("rendered"))
    return kept.join(texts, "conv")
