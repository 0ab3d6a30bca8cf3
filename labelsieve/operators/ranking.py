"""Positions in an order without ever sorting a whole table, or a whole hot group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits
SEQUENCE_WIDTH = 1 << 20


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key is a value like any other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys]
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])


def ordered_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position in a total order.

    The rows are range-partitioned and sorted once; the position inside the partition plus the sizes of the
    partitions before it is the rank. The sorted rows are checkpointed because range boundaries are sampled: a
    recomputed stage could draw others and disagree with the sizes.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_shard", F.shiftright("_at", _ROW_BITS))
    )
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_shard").agg(F.count("*").alias("_size")).select(
        "_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    within = F.col("_at") - F.shiftleft("_shard", _ROW_BITS)
    return (
        placed.join(starts, "_shard")
        .withColumn(out, (F.col("_start") + within + 1).cast("long"))
        .drop("_at", "_shard", "_start")
    )


def grouped_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """1-based position inside each group, NULL being one; a group may span any number of partitions."""
    ranked = ordered_rank(df, [*[F.col(name).asc() for name in groups], *order], "_overall")
    firsts = ranked.groupBy(*groups).agg(F.min("_overall").alias("_first"))
    return (
        join_null_safe(ranked, firsts, groups)
        .withColumn(out, F.col("_overall") - F.col("_first") + 1)
        .drop("_overall", "_first")
    )


def bucketed_rank(
    df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """1-based position inside each group when ``bucket`` is an order-preserving prefix of ``order``.

    Made for hash orders: the leading hash digits spread even one huge group evenly over the buckets, so each
    window holds one bucket of one group. NULL is a group too.
    """
    keys = [*groups, "_bucket"]
    keyed = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys).agg(F.count("*").alias("_size")).select(
        *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        join_null_safe(keyed.withColumn("_local", local), starts, keys)
        .withColumn(out, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_bucket", "_start", "_local")
    )


def hex_bucket(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def neighbour_value(
    df: DataFrame, group: str, sequence: str, value: Column, out: str,
    backwards: bool = True, width: int = SEQUENCE_WIDTH,
) -> DataFrame:
    """``value`` of the previous (or next) row of the same group in ``sequence`` order.

    A plain lag would put a hot group's whole history into one window. ``sequence`` is an integer, unique within
    a group, so a stretch of ``width`` numbers holds at most ``width`` rows of a group: lag runs inside (group,
    stretch), and the first row of a stretch takes the last value of the group's stretch before it.
    """
    keys = [group, "_stretch"]
    keyed = df.withColumn("_value", value).withColumn("_stretch", F.floor(F.col(sequence) / width))
    edge, step = (F.max_by, F.lag) if backwards else (F.min_by, F.lead)
    carried = (
        keyed.groupBy(*keys).agg(edge("_value", sequence).alias("_edge"))
        .select(*keys, step("_edge").over(Window.partitionBy(group).orderBy("_stretch")).alias("_carried"))
    )
    inside = Window.partitionBy(*keys).orderBy(sequence)
    return (
        keyed.withColumn("_inside", step("_value").over(inside))
        .withColumn("_at_edge", step(F.lit(1)).over(inside).isNull())
        .join(carried, keys)
        .withColumn(out, F.when(F.col("_at_edge"), F.col("_carried")).otherwise(F.col("_inside")))
        .drop("_stretch", "_value", "_carried", "_inside", "_at_edge")
    )
