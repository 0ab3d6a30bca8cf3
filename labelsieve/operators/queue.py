"""The review queue: order, filter, rank, page, look up, neighbours, references, plot queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import item_hash, matches_search
from labelsieve.functions.vectors import is_finite_number
from labelsieve.operators.ranking import join_null_safe, ordered_rank
from labelsieve.schema import MAX_RESULT_PAGE, PLOT_LIMIT, QUEUE_LIMIT
from labelsieve.session import materialize, small_table


#: What the queue's order depends on.
QUEUE_COLUMNS = ("id", "status", "suspicion_score")


def numeric_id() -> Column:
    return F.expr("try_cast(id AS double)")


def score() -> Column:
    """The suspicion score, NULL when it is not a finite number."""
    return F.when(is_finite_number(F.col("suspicion_score")), F.col("suspicion_score"))


def priority_keys() -> list[Column]:
    """Most suspicious first, unscored last, then ids as numbers, then as text."""
    return [score().desc_nulls_last(), numeric_id().asc_nulls_last(), F.col("id").asc()]


def queue_keys() -> list[Column]:
    """Pending items before reviewed ones, each in priority order."""
    return [(F.col("status") != "pending").asc(), *priority_keys()]


def priority_order(items: DataFrame) -> DataFrame:
    return items.orderBy(*priority_keys())


def review_filter(
    items: DataFrame, status: str | None = None, label: str | None = None, min_score: float = 0.0, text: str = "",
) -> DataFrame:
    """An item without a score passes only when no minimum is asked for."""
    kept = F.when(score().isNull(), F.lit(min_score <= 0)).otherwise(score() >= min_score)
    if status is not None:
        kept = kept & (F.col("status") == status)
    if label is not None:
        kept = kept & (F.col("label") == label)
    if text.strip():
        kept = kept & matches_search(F.col("relative_path"), F.col("label"), F.col("suggested_label"), text)
    return items.filter(kept)


def pending_first(items: DataFrame) -> DataFrame:
    return items.orderBy(*queue_keys())


def queue_rank(items: DataFrame) -> DataFrame:
    """Every item with its 1-based queue position. Only the keys of the order are sorted and written; ids are unique."""
    ranks = ordered_rank(items.select(*QUEUE_COLUMNS), queue_keys()).select("id", "rank")
    return items.join(ranks, "id")


def queue_counts(items: DataFrame, filtered: DataFrame) -> DataFrame:
    shown = filtered.agg(F.count("*").cast("long")).scalar()
    return items.agg(F.count("*").cast("long").alias("total")).select(shown.alias("filtered"), "total")


def queue_top(items: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Head of the queue; sorted per partition and merged, never fully sorted."""
    return items.orderBy(*queue_keys()).limit(limit)


def page_keys() -> list[Column]:
    """Paging order: here ids compare as text."""
    return [F.col("suspicion_score").desc(), F.col("id").asc()]


def result_page(results: DataFrame, page: int, limit: int) -> DataFrame:
    if page < 1 or not 1 <= limit <= MAX_RESULT_PAGE:
        raise ValueError(f"page starts at 1 and limit is 1..{MAX_RESULT_PAGE}")
    return results.orderBy(*page_keys()).offset((page - 1) * limit).limit(limit)


def next_page(results: DataFrame, last_score: float, last_id: str, limit: int) -> DataFrame:
    """The page after a known row. Its filter reaches the scan, so deep pages cost no more than the first."""
    later = (F.col("suspicion_score") < last_score) | (
        (F.col("suspicion_score") == last_score) & (F.col("id") > last_id)
    )
    return results.filter(later).orderBy(*page_keys()).limit(limit)


def page_count(results: DataFrame, limit: int) -> DataFrame:
    return results.agg(F.ceil(F.count("*") / limit).cast("long").alias("pages"))


def write_results(results: DataFrame, path: str) -> None:
    """Result store: range-partitioned and sorted in paging order, so min/max statistics prune pages."""
    results.repartitionByRange(*page_keys()).sortWithinPartitions(*page_keys()).write.parquet(path)


def write_ranked(results: DataFrame, path: str) -> None:
    """Result store with a rank index: rows in paging order by range, ``shard`` and ``place``, and each shard's start.

    A row's rank is its shard's start plus its place, so a page knows its shards from the index, which has a row a shard.
    """
    keys = page_keys()
    placed = results.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed.withColumns({"shard": F.shiftright("_at", 33), "place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at").write.partitionBy(
        "shard").parquet(f"{path}/rows")
    sizes = results.sparkSession.read.parquet(f"{path}/rows").groupBy("shard").agg(F.count("*").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def ranked_rows(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """``count`` rows of a ranked store from position ``first`` (0-based) on, with their 1-based ``rank``.

    At most ``count`` shards hold them; only their files are listed in the plan, and their places reach the scan.
    """
    shards = spark.read.parquet(f"{path}/index").filter((F.col("start") < first + count) & (F.col("start") + F.col("size") > first)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    wanted, start = F.lit(False), F.lit(None).cast("long")
    for s in shards:
        wanted = wanted | ((F.col("shard") == s.shard) & (F.col("place") >= first - s.start) & (F.col("place") < first + count - s.start))
        start = F.when(F.col("shard") == s.shard, s.start).otherwise(start)
    inside = F.col("shard").isin([s.shard for s in shards]) if shards else F.lit(False)
    return rows.filter(inside & wanted).withColumn("rank", start + F.col("place") + 1).drop("shard", "place")


def ranked_page(spark: SparkSession, path: str, page: int, limit: int) -> DataFrame:
    """A page of a ranked store in paging order; a deep page costs what the first one does."""
    if page < 1 or not 1 <= limit <= MAX_RESULT_PAGE:
        raise ValueError(f"page starts at 1 and limit is 1..{MAX_RESULT_PAGE}")
    return ranked_rows(spark, path, (page - 1) * limit, limit).orderBy("rank")


def item_lookup(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("id") == item_id)


def queue_neighbors(items: DataFrame) -> DataFrame:
    """(id, rank, previous_id, next_id, next_pending): the ring order of the queue, and where a decision leads.

    Neighbours come from equi-joins on the unique rank, so no window spans the queue.
    """
    ranked = materialize(queue_rank(items).select("id", "status", "rank"))
    total = ranked.agg(F.max("rank")).scalar()
    waiting = [r.id for r in ranked.filter("status = 'pending'").orderBy("rank").limit(2).collect()] + [None, None]
    before = ranked.select(F.col("id").alias("previous_id"), (F.pmod(F.col("rank"), total) + 1).alias("rank"))
    after = ranked.select(
        F.col("id").alias("next_id"),
        F.when(F.col("rank") == 1, total).otherwise(F.col("rank") - 1).alias("rank"),
    )
    first, second = (F.lit(value).cast("string") for value in waiting[:2])
    return ranked.join(before, "rank").join(after, "rank").select(
        "id", "rank", "previous_id", "next_id",
        F.when(F.col("id").eqNullSafe(first), second).otherwise(first).alias("next_pending"),
    )


def reference_keys() -> list[Column]:
    """Confirmed first, scored before unscored, least suspicious first."""
    return [
        (F.col("status") != "correct").asc(), score().isNull().asc(), score().asc_nulls_last(),
        numeric_id().asc_nulls_last(), F.col("id").asc(),
    ]


def reference_samples(items: DataFrame, target: Column | None = None, count: int = 3) -> DataFrame:
    """(id, target_class, rank, reference_id): the best other items of the class an item is compared with.

    The best ``count``+1 of each class are found once and pinned as a small table; one of them may be the item itself.
    """
    per_class = Window.partitionBy("label").orderBy(*reference_keys())
    best = small_table(
        items.withColumn("_rn", F.row_number().over(per_class)).filter(F.col("_rn") <= count + 1)
        .groupBy("label").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "id"))), lambda entry: entry["id"]).alias("_best"))
        .withColumnRenamed("label", "target_class")
    )
    wanted = items.select("id", (F.col("label") if target is None else target).alias("target_class"))
    others = F.slice(F.filter("_best", lambda other: other != F.col("id")), 1, count)
    return wanted.join(best, "target_class").select("id", "target_class", F.posexplode(others).alias("_at", "reference_id")).select(
        "id", "target_class", (F.col("_at") + 1).cast("long").alias("rank"), "reference_id"
    )


def finite_points(items: DataFrame) -> DataFrame:
    return items.filter(is_finite_number(F.col("x")) & is_finite_number(F.col("y")))


def plot_bounds(items: DataFrame) -> DataFrame:
    return finite_points(items).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.count("*").cast("long").alias("n"),
    )


def sample_quotas(groups: DataFrame, limit: int) -> DataFrame:
    """(label, status, n, quota): one each, the rest in proportion, leftovers in rounds by largest fraction.

    ``groups`` has one row per (label, status). The rounds are solved by water-filling: ``level`` full rounds fit into
    the leftovers, and what then remains goes to the first groups that still have room.
    """
    everything = Window.partitionBy(F.lit(1))
    stats = groups.withColumns({
        "_groups": F.count("*").over(everything), "_total": F.sum("n").over(everything),
    })
    exact = (F.lit(limit) - F.col("_groups")) * F.col("n") / F.col("_total")
    base = stats.withColumn("_exact", exact).withColumn(
        "_base", 1 + F.least(F.col("n") - 1, F.floor("_exact"))
    ).withColumns({
        "_fraction": F.col("_exact") - F.floor("_exact"),
        "_room": F.col("n") - F.col("_base"),
        "_spare": F.lit(limit) - F.sum("_base").over(everything),
    })
    by_room = Window.orderBy("_room").rowsBetween(Window.unboundedPreceding, 0)
    filled = base.withColumns({
        "_at": F.row_number().over(Window.orderBy("_room")), "_below": F.sum("_room").over(by_room),
    }).withColumn("_cost", F.col("_below") + (F.col("_groups") - F.col("_at")) * F.col("_room"))
    fits = F.col("_cost") <= F.col("_spare")
    step = filled.withColumns({
        "_level": F.coalesce(F.max(F.when(fits, F.col("_room"))).over(everything), F.lit(0)),
        "_used": F.coalesce(F.max(F.when(fits, F.col("_cost"))).over(everything), F.lit(0)),
    })
    open_groups = F.count(F.when(F.col("_room") > F.col("_level"), 1)).over(everything)
    level = step.withColumn("_open", open_groups).withColumn(
        "_rounds", F.when(F.col("_open") > 0, F.col("_level") + F.floor((F.col("_spare") - F.col("_used")) / F.col("_open")))
        .otherwise(F.col("_level"))
    ).withColumn("_given", F.sum(F.least("_room", "_rounds")).over(everything))
    first = Window.orderBy((F.col("_room") > F.col("_rounds")).desc(), F.col("_fraction").desc(), "label", "status")
    last = level.withColumn("_turn", F.row_number().over(first)).withColumn(
        "_extra", ((F.col("_room") > F.col("_rounds")) & (F.col("_turn") <= F.col("_spare") - F.col("_given"))).cast("int")
    )
    quota = F.when(F.col("_groups") >= limit, F.lit(1)).otherwise(
        F.col("_base") + F.least("_room", "_rounds") + F.col("_extra")
    )
    return last.select("label", "status", "n", quota.cast("long").alias("quota"))


def plot_sample(items: DataFrame, limit: int = PLOT_LIMIT) -> DataFrame:
    """At most ``limit`` items, stratified by (label, status); inside a stratum the lowest hashes win.

    The choice depends only on ids and paths, so it is stable. Rows are counted by the leading bits of their hash; only
    those in the few buckets that a stratum's quota reaches are ranked, bucket by bucket.
    """
    stratum = ["label", "status"]
    hashed = items.withColumn("hash", item_hash(F.col("id"), F.col("relative_path"))).withColumn("_bucket", F.shiftright("hash", 20))
    sizes = materialize(hashed.groupBy(*stratum, "_bucket").agg(F.count("*").alias("_size")))
    quotas = small_table(sample_quotas(sizes.groupBy(*stratum).agg(F.sum("_size").alias("n")), limit))
    before = Window.partitionBy(*stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*stratum, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    needed = small_table(join_null_safe(starts, quotas.select(*stratum, "quota"), stratum).filter("_start < quota"))
    inside = F.row_number().over(Window.partitionBy(*stratum, "_bucket").orderBy("hash", "id"))
    chosen = join_null_safe(hashed, needed, [*stratum, "_bucket"]).withColumn("_local", inside)
    chosen = chosen.filter(F.col("_start") + F.col("_local") <= F.col("quota"))
    return chosen.drop("_bucket", "_start", "_local", "quota").orderBy("hash", "id").limit(limit)


def with_selected(sample: DataFrame, selected: DataFrame) -> DataFrame:
    """The sample with the selected item (one row) in place of its last point, unless it is in there already."""
    pinned = finite_points(selected)
    extra = pinned.join(sample.select("id"), "id", "left_anti")
    if extra.isEmpty():
        return sample
    last = sample.orderBy(F.col("hash").desc(), F.col("id").desc()).limit(1).select("id")
    shown = sample.join(last, "id", "left_anti")
    return shown.unionByName(extra, allowMissingColumns=True)


# one step of the arrow keys: unit directions
DIRECTIONS = {"left": (-1, 0), "right": (1, 0), "up": (0, 1), "down": (0, -1)}


def spatial_step(items: DataFrame, origin_id: str, origin_x: float, origin_y: float) -> DataFrame:
    """(direction, next_id): the cheapest point ahead of one origin in each direction, in one aggregation."""
    dx, dy = F.col("x") - F.lit(origin_x), F.col("y") - F.lit(origin_y)
    points = finite_points(items).filter(F.col("id") != origin_id)
    picks = []
    for name, (ax, ay) in DIRECTIONS.items():
        ahead, aside = dx * ax + dy * ay, F.abs(dx * ay - dy * ax)
        cost = F.sqrt(dx * dx + dy * dy) * (1 + 3 * aside / (ahead + 0.001))
        key = F.when(ahead > 0, F.struct(cost.alias("cost"), numeric_id().alias("n"), F.col("id").alias("id")))
        picks.append(F.min(key).alias(name))
    best = points.agg(*picks)
    rows = F.array(*[F.struct(F.lit(n).alias("direction"), F.col(f"{n}.id").alias("next_id")) for n in DIRECTIONS])
    return best.select(F.explode(rows).alias("_r")).select("_r.direction", "_r.next_id")


def grid_nearest(points: DataFrame, pointers: DataFrame, radius: float = 14.0, cell: float = 32.0) -> DataFrame:
    """(pointer_id, point_id, distance): the nearest point closer than ``radius``, found through a cell grid.

    ``pointers`` (pointer_id, x, y) is the small side: each pointer opens the cells around it and meets points by
    cell. The points then shrink to one row per pointer before any shuffle.
    """
    reach = -(-radius // cell)
    steps = F.array(*[F.lit(float(i)) for i in range(-int(reach), int(reach) + 1)])
    asked = small_table(pointers.select(
        "pointer_id", F.col("x").alias("px"), F.col("y").alias("py"),
        F.explode(steps).alias("_i"), F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"),
    ).withColumn("_j", F.explode(steps)).select(
        "pointer_id", "px", "py", (F.col("_cx") + F.col("_i")).cast("long").alias("cx"),
        (F.col("_cy") + F.col("_j")).cast("long").alias("cy"),
    ))
    placed = finite_points(points).select(
        F.col("id").alias("point_id"), "x", "y",
        F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"),
    )
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    distance = F.sqrt(dx * dx + dy * dy)
    near = placed.join(asked, ["cx", "cy"]).withColumn("distance", distance).filter(F.col("distance") < radius)
    best = near.groupBy("pointer_id").agg(F.min(F.struct("distance", "point_id")).alias("_best"))
    return best.select("pointer_id", "_best.point_id", "_best.distance")
