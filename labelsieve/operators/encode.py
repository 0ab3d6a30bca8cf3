"""Class codes, class counts, stratified folds, balanced weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import seeded_digest
from labelsieve.operators.ranking import bucketed_rank, hex_bucket
from labelsieve.schema import MAX_FOLDS
from labelsieve.session import small_table

SEED = 42


def class_codes(df: DataFrame, label: str) -> DataFrame:
    """One row per class that occurs: (label, code, n), codes in label order from 0.

    The rows are counted before the window, so the window only sees one row per class.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    code = (F.row_number().over(Window.orderBy(label)) - 1).cast("long")
    return small_table(counts.select(label, code.alias("code"), "n"))


def class_encode(df: DataFrame, label: str, codes: DataFrame | None = None) -> DataFrame:
    codes = class_codes(df, label) if codes is None else codes
    return df.join(codes.select(label, "code"), label)


def class_summary(codes: DataFrame) -> DataFrame:
    """Class count, smallest class and the number of folds it allows; no folds means centroids."""
    small = F.min("n")
    usable = (F.count("*") > 1) & (small >= 2)
    return codes.agg(
        F.count("*").cast("long").alias("classes"),
        F.sum("n").cast("long").alias("items"),
        small.alias("smallest"),
        F.when(usable, F.least(F.lit(MAX_FOLDS).cast("long"), small)).otherwise(F.lit(0)).cast("long").alias("folds"),
    )


def stratified_folds(
    df: DataFrame, label: str, item: str, folds: int | Column, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Deterministic shuffled folds: the classes are dealt out in the order of a seeded id hash."""
    shuffled = df.withColumn("_digest", seeded_digest(F.col(item), F.lit(seed)))
    dealt = bucketed_rank(
        shuffled, [label], hex_bucket(F.col("_digest")), [F.col("_digest"), F.col(item)], "_rank"
    )
    count = folds if isinstance(folds, Column) else F.lit(folds)
    return dealt.withColumn(out, ((F.col("_rank") - 1) % count).cast("long")).drop("_digest", "_rank")


def class_weights(df: DataFrame, label: str, fold: str, folds: int) -> DataFrame:
    """Balanced weight n/(C*n_c) of every class, measured on the rows outside each fold.

    One pass counts (fold, label); what a fold trains on is then "all minus the fold" on that small table.
    """
    if folds < 1:
        raise ValueError("at least one fold is needed")
    held = df.groupBy(fold, label).agg(F.count("*").alias("_held"))
    totals = held.groupBy(label).agg(F.sum("_held").alias("_n"))
    grid = totals.withColumn(fold, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    trained = grid.join(held, [fold, label], "left").withColumn(
        "_train", F.col("_n") - F.coalesce("_held", F.lit(0))
    ).filter("_train > 0")
    whole = Window.partitionBy(fold)
    return trained.select(
        fold, label,
        F.col("_train").cast("long").alias("train_rows"),
        (F.sum("_train").over(whole) / (F.count("*").over(whole) * F.col("_train"))).alias("weight"),
    )
