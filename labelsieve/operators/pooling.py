"""Pooling of patch vectors into one vector per item."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WEIGHT = 1e-8


def masked_pool(patches: DataFrame, item: str, vector: str, weight: str | None = None, cls_flag: str | None = None) -> DataFrame:
    """(item, pooled): mask-weighted mean of an item's patches.

    Without a mask, or with a mask that sums to nothing, the plain mean. With a mask on a patch count that is no square
    grid, the vector flagged by ``cls_flag``. The sums combine on the map side.
    """
    is_cls = F.coalesce(F.col(cls_flag), F.lit(False)) if cls_flag else F.lit(False)
    weighted = F.when(is_cls, F.lit(0.0)).otherwise(F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = patches.select(
        F.col(item), is_cls.alias("_cls"), array_to_vector(F.col(vector)).alias("_v"),
        F.when(is_cls, 0.0).otherwise(1.0).alias("_one"), F.coalesce(weighted, F.lit(0.0)).alias("_w"),
    )
    tiny = F.lit(1e-300)  # a mean needs some weight; this much leaves every real mean as it is
    pooled = rows.groupBy(item).agg(
        Summarizer.mean(F.col("_v"), F.greatest("_one", tiny)).alias("_plain"),
        Summarizer.mean(F.col("_v"), F.greatest("_w", tiny)).alias("_masked"),
        F.max_by("_v", F.when(F.col("_cls"), 1)).alias("_token"),
        F.sum("_w").alias("_mass"), F.sum("_one").alias("_n"),
    )
    side = F.floor(F.sqrt("_n"))
    if weight is None:
        chosen = F.col("_plain")
    else:
        chosen = F.when((side * side != F.col("_n")) & F.col("_token").isNotNull(), F.col("_token")).when(
            F.col("_mass") <= MIN_WEIGHT, F.col("_plain")).otherwise(F.col("_masked"))
    return pooled.select(item, vector_to_array(chosen).alias("pooled"))
