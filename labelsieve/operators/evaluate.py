"""How good a ranking is: precision, recall and lift at K, baselines, percentile gate, noise injection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import seeded_digest
from labelsieve.operators.encode import class_codes
from labelsieve.operators.ranking import bucketed_rank, grouped_rank, hex_bucket
from labelsieve.session import materialize, small_table

# fixed values: review budgets of the validation protocol
ABSOLUTE_BUDGETS = (10, 25, 50, 100)
RELATIVE_BUDGETS = (1, 5, 10)  # percent, rounded up


def synthetic_clusters(
    spark: SparkSession, per_class: int, classes: int = 3, width: int = 6, sigma: float = 0.025, seed: int = 42
) -> DataFrame:
    """(id, features, truth): Gaussian clusters around unit vectors."""
    truth = F.floor(F.col("id") / per_class).cast("int")
    axes = [F.when(truth == axis, 1.0).otherwise(0.0) + F.randn(seed + axis) * sigma for axis in range(width)]
    return spark.range(per_class * classes).select("id", F.array(*axes).alias("features"), truth.alias("truth"))


def inject_label_noise(df: DataFrame, label: str, chosen: Column, out: str = "label") -> DataFrame:
    """Move the chosen rows to the next class (in class order, cyclic); the old label stays as ``truth``."""
    codes = class_codes(df, label)
    ring = codes.select(F.col(label).alias("truth"), F.col("code").alias("_code"))
    following = codes.select(F.col(label).alias("_next"), F.pmod(F.col("code") - 1, codes.agg(F.count("*")).scalar()).alias("_code"))
    ring = ring.join(following, "_code").drop("_code")
    shifted = df.withColumn("injected", chosen).withColumnRenamed(label, "truth").join(ring, "truth")
    return shifted.withColumn(out, F.when(F.col("injected"), F.col("_next")).otherwise(F.col("truth"))).drop("_next")


def digest_chosen(item: Column, seed: int, percent: int) -> Column:
    """A fixed pseudo-random share of the ids, the same on every run and every engine."""
    bucket = F.conv(F.substring(seeded_digest(item, F.lit(seed)), 1, 8), 16, 10).cast("long")
    return bucket % 100 < percent


def budgets(totals: DataFrame) -> DataFrame:
    """Totals (groups.., n, errors) with one row per review budget: budget name and k."""
    absolute = [F.struct(F.lit(f"k{k}").alias("budget"), F.lit(k).cast("long").alias("k")) for k in ABSOLUTE_BUDGETS]
    relative = [
        F.struct(F.lit(f"{p}%").alias("budget"), F.ceil(F.col("n") * p / 100).cast("long").alias("k"))
        for p in RELATIVE_BUDGETS
    ]
    named = totals.withColumn("_b", F.explode(F.array(*absolute, *relative)))
    return named.select("*", "_b.budget", "_b.k").drop("_b").filter("k <= n")


def metrics(hits: Column, k: Column, errors: Column, n: Column) -> dict[str, Column]:
    precision = hits / k
    return {
        "precision_at_k": precision,
        "recall_at_k": F.when(errors > 0, hits / errors),
        "lift_at_k": F.when(errors > 0, precision / (errors / n)),
    }


def at_budgets(ranked: DataFrame, error: str, groups: Sequence[str], totals: DataFrame | None = None) -> DataFrame:
    """Metrics of a ranked table (groups.., rank, error flag) at every budget.

    ``totals`` (groups.., n, errors) are needed if ``ranked`` holds only the first rows of an order.

    One aggregation counts the hits of all budgets: an error falls into the smallest budget that includes it, and a sum
    over the few budgets of a group does the rest.
    """
    keys = list(groups)
    if totals is None:
        totals = ranked.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.sum(F.col(error).cast("long")).alias("errors"))
    table = small_table(budgets(totals))
    limits = table.groupBy(*keys).agg(F.array_sort(F.collect_set("k")).alias("_ks"))
    slot = F.try_element_at(F.filter("_ks", lambda k: k >= F.col("rank")), F.lit(1))
    counted = (
        ranked.filter(F.col(error)).select(*keys, "rank").join(limits, keys)
        .withColumn("_slot", slot).filter("_slot IS NOT NULL").groupBy(*keys, "_slot").agg(F.count("*").alias("_hits"))
    )
    hits = F.coalesce(F.sum(F.when(F.col("_slot") <= F.col("k"), F.col("_hits"))), F.lit(0)).cast("long")
    result = table.join(counted, keys, "left").groupBy(*keys, "budget", "k", "n", "errors").agg(hits.alias("tp"))
    return result.withColumns(metrics(F.col("tp"), F.col("k"), F.col("errors"), F.col("n")))


def ranking_metrics(df: DataFrame, item: str, score: str, error: str) -> DataFrame:
    """Precision, recall and lift of the score order over the whole table, with an ``overall`` group."""
    return metrics_by_class(df.withColumn("_all", F.lit("overall")), item, score, error, "_all").drop("_all")


def metrics_by_class(df: DataFrame, item: str, score: str, error: str, group: str) -> DataFrame:
    order = [F.col(score).desc_nulls_last(), F.col(item).asc()]
    return at_budgets(grouped_rank(df.select(item, score, error, group), [group], order), error, [group])


def random_baseline(df: DataFrame, item: str, error: str, seeds: Sequence[int]) -> DataFrame:
    """(budget, k, mean_tp, low_tp, high_tp): hits of random orders over several seeds, with a 5..95 % interval.

    Only the rows that a random order puts inside the largest budget matter. Their digests lie below a threshold that
    leaves a margin of six standard deviations, so of each order little more than that budget is shuffled; should an order
    have fewer rows below the threshold than the budget, all orders are ranked whole.
    """
    whole = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(error).cast("long")), F.lit(0)).alias("errors")).first()
    largest = max([k for k in ABSOLUTE_BUDGETS if k <= whole.n] + [-(-whole.n * p // 100) for p in RELATIVE_BUDGETS] + [0])
    share = largest / max(whole.n, 1)
    share += 6 * (share / max(whole.n, 1)) ** 0.5
    rows = df.select(F.col(item), F.col(error)).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    hashed = rows.withColumn("_digest", seeded_digest(F.col(item), F.col("seed")))
    first = hashed
    if share < 1:
        first = hashed.filter(F.substring("_digest", 1, 8) < F.lit(f"{int(share * 16 ** 8):08x}"))
        enough = first.groupBy("seed").count().filter(F.col("count") >= largest).count()
        first = first if enough == len(set(seeds)) else hashed
    ranked = bucketed_rank(first, ["seed"], hex_bucket(F.col("_digest")), [F.col("_digest"), F.col(item)])
    totals = df.sparkSession.createDataFrame([(int(s), whole.n, whole.errors) for s in sorted(set(seeds))], "seed int, n long, errors long")
    per_seed = at_budgets(ranked.select("seed", "rank", error), error, ["seed"], totals if whole.n else totals.limit(0))
    return per_seed.groupBy("budget", "k").agg(
        F.avg("tp").alias("mean_tp"),
        F.percentile("tp", F.lit(0.05)).alias("low_tp"),
        F.percentile("tp", F.lit(0.95)).alias("high_tp"),
    )


def load_order_baseline(df: DataFrame, ordinal: str, error: str) -> DataFrame:
    """Metrics of working through the items in load order."""
    rows = df.select(F.col(ordinal), F.col(error), F.lit("load_order").alias("_all"))
    return at_budgets(grouped_rank(rows, ["_all"], [F.col(ordinal).asc()]), error, ["_all"]).drop("_all")


def exact_percentile(df: DataFrame, column: str, fraction: float) -> Column:
    """Interpolated percentile as a scalar, from the positions of distinct values.

    Equal values are counted before anything moves, so a value that most rows share is one row; the distinct values are
    spread by range, and the counts of the partitions before give each value the positions that its rows take.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    placed = materialize(counted.repartitionByRange(column).withColumn("_shard", F.spark_partition_id()))
    sizes = placed.groupBy("_shard").agg(F.sum("_n").alias("_size"))  # a row per partition
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard").orderBy(column)
    ends = placed.withColumn("_end", F.sum("_n").over(inside)).join(starts, "_shard").select(
        column, (F.col("_start") + F.col("_end") - F.col("_n")).alias("_first"), (F.col("_start") + F.col("_end") - 1).alias("_last"))
    at = (ends.agg(F.max("_last")).scalar()) * F.lit(fraction)
    around = ends.filter((F.col("_first") <= F.ceil(at)) & (F.col("_last") >= F.floor(at)))
    low, high = F.min(column), F.max(column)
    return around.agg((low + (high - low) * F.max(at - F.floor(at)))).scalar()


def percentile_gate(df: DataFrame, score: str, injected: str, fraction: float = 0.95) -> DataFrame:
    """(threshold, injected_items, passed): injected items that score at or above the percentile of all scores."""
    threshold = exact_percentile(df, score, fraction)
    return df.filter(F.col(injected)).agg(
        F.max(threshold).alias("threshold"), F.count("*").cast("long").alias("injected_items"),
        F.count_if(F.col(score) >= threshold).cast("long").alias("passed"),
    )
