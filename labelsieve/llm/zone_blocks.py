"""Hard negatives by exact inner products over blocks in the order of a Hilbert curve.

Candidates are ordered along a Hilbert curve through all dimensions and packed into blocks, one Parquet row each, with the
least and greatest value of every dimension (its zone map) and the labels inside. The anchors of neighbouring blocks form
a tile. Interval arithmetic bounds the product of an anchor with any row of a block from both sides; a block is read for an
anchor only if these bounds let it change the anchor's result. Two rounds do this: the first finds each anchor's best
rows of its own label, its positives; these fix a window of scores for each positive, and the second round finds the
best rows of other labels inside the windows. Both start from the blocks around the anchor, whose scores already rule
out most blocks that the bounds can rule out at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.session import materialize

BLOCK_ROWS = 512
TILE_BLOCKS = 8
PAGE_BLOCKS = 256
TILES_TOGETHER = 16
PAGE_TILES = 512
CURVE_BITS = 2
_SHARD = 1 << 33
#: Products of doubles are exact below this; beyond it products are taken in 64-bit integers.
_EXACT = 2.0 ** 52


@dataclass(frozen=True)
class Windows:
    """Negatives of a positive with score p lie where low * p <= scale * score <= high * p."""

    positives: int = 5
    negatives: int = 10
    scale: int = 100
    low: int = 30
    high: int = 90

    def bounds(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -((-self.low * scores) // self.scale), self.high * scores // self.scale


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points on a Hilbert curve, as fixed-width big-endian byte strings.

    ``cells`` (points x dimensions) lie in 0 .. 2 ** bits - 1. The axes are turned step by step from the highest bit down
    (inverse undo), then Gray-coded across the dimensions, and their bits are interleaved.
    """
    axes = cells.astype(np.uint8).T.copy()
    n = len(axes)
    if n == 0:
        return np.zeros((cells.shape[0], 0), dtype=np.uint8)
    for bit in range(bits - 1, 0, -1):
        high, below = np.uint8(1 << bit), np.uint8((1 << bit) - 1)
        for i in range(n):
            flip = (axes[i] & high) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & below).astype(np.uint8)
            axes[0] ^= np.where(flip, below, swap).astype(np.uint8)
            axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], dtype=np.uint8)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & np.uint8(1 << bit), np.uint8((1 << bit) - 1), np.uint8(0))
    axes ^= turn
    planes = [(axes >> np.uint8(bit)) & np.uint8(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, exact as long as they fit 64 bits."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if most < _EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def interval_bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of every vector with any point of every box, as doubles rounded outwards."""
    up, down = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-9 * (np.abs(up) @ np.maximum(np.abs(low), np.abs(high)).T + np.abs(down) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, greatest + slack


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int, rows: int) -> np.ndarray:
    """A list column of vectors, or of matrices flattened row by row, as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, dims)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def curve_order(rows: DataFrame, dims: int, scale: float) -> DataFrame:
    """Rows (id, label, vec) with ``curve``, the place of their vector; short vectors end in zeros."""
    cuts = np.arange(1 - (1 << CURVE_BITS - 1), 1 << CURVE_BITS - 1) * scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), dims, batch.num_rows)
            keys = hilbert_keys(np.searchsorted(cuts, vectors, side="right"), CURVE_BITS)
            curve = pa.array([key.tobytes() for key in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, curve], names=["id", "label", "vec", "anchor", "curve"])

    return rows.select("id", "label", "vec", "anchor").mapInArrow(run, "id long, label long, vec array<long>, anchor boolean, curve binary")


_BLOCK = "block long, n int, ids array<long>, labels array<long>, anchors array<boolean>, vecs array<long>, low array<long>, high array<long>, kinds array<long>"


def pack_blocks(ordered: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """One row for every ``block_rows`` neighbours of the curve, with the block's zone map and its labels.

    ``block`` numbers blocks upwards along the curve: the partition, then the block inside it.
    """
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def pack(block: int, rows: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(rows["vec"], dims, rows.num_rows)
        labels = rows["label"].to_numpy()
        lists = [
            (rows["id"].to_numpy(), pa.int64()), (labels, pa.int64()), (rows["anchor"].to_numpy(), pa.bool_()), (vectors.ravel(), pa.int64()),
            (vectors.min(axis=0), pa.int64()), (vectors.max(axis=0), pa.int64()), (np.unique(labels), pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([rows.num_rows], pa.int32()), *[_lists(v, np.array([len(v)]), k) for v, k in lists]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() * _SHARD, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= block_rows:
                yield pack(block, held.slice(0, block_rows))
                held, block = held.slice(block_rows), block + 1
        if held is not None and held.num_rows:
            yield pack(block, held)

    return ordered.mapInArrow(run, _BLOCK)


def zone_pages(blocks: DataFrame) -> DataFrame:
    """Zone maps of all blocks, some hundred in a row: (page, blocks, low, high, kinds, kind_sizes); pages count from 0."""
    shard = F.floor(F.col("block") / _SHARD)
    counts = blocks.groupBy(shard.alias("_shard")).agg(F.count("*").alias("_blocks"))
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the order
    starts = counts.select("_shard", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_start"))
    numbered = blocks.select("block", "low", "high", "kinds", shard.alias("_shard")).join(starts, "_shard").withColumn(
        "page", F.floor((F.col("_start") + F.col("block") - F.col("_shard") * _SHARD) / PAGE_BLOCKS))
    zones = F.sort_array(F.collect_list(F.struct("block", "low", "high", "kinds"))).alias("_z")
    return numbered.groupBy("page").agg(zones).select(
        "page", F.col("_z.block").alias("blocks"), F.flatten("_z.low").alias("low"), F.flatten("_z.high").alias("high"),
        F.flatten("_z.kinds").alias("kinds"), F.transform("_z.kinds", F.size).alias("kind_sizes"))


_TILE = "tile long, ids array<long>, labels array<long>, vecs array<long>, scores array<long>, sizes array<int>, cuts array<long>"
_FOUND = "anchor long, positive_score long, id long, score long"
_LEAST = np.iinfo(np.int64).min


def best_of_windows(
    scores: np.ndarray, ids: np.ndarray, usable: np.ndarray, lows: np.ndarray, highs: np.ndarray, most: int,
) -> list[np.ndarray]:
    """By window the places of its best rows: usable ones with low <= score <= high, by score downwards, then id."""
    places = np.flatnonzero(usable)
    order = places[np.lexsort((ids[places], -scores[places]))]
    ranked = -scores[order]
    begins, ends = np.searchsorted(ranked, -highs, side="left"), np.searchsorted(ranked, -lows, side="right")
    return [order[begin:min(end, begin + most)] for begin, end in zip(begins, ends)]


class _Tile:
    """Anchors of a tile: ids, labels, vectors and, in the second round, the distinct positive scores of each."""

    def __init__(self, row: dict, dims: int):
        self.ids, self.labels = np.array(row["ids"], dtype=np.int64), np.array(row["labels"], dtype=np.int64)
        self.vectors = np.array(row["vecs"], dtype=np.int64).reshape(len(self.ids), dims)
        self.scores, self.cuts = np.array(row["scores"], dtype=np.int64), np.array(row["cuts"], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)

    def windows(self, anchor: int, rule: Windows, negatives: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By window the positive's score, and the least and greatest score that can still enter the result."""
        own = slice(self.bounds[anchor], self.bounds[anchor + 1])
        scores = self.scores[own]
        lows, highs = rule.bounds(scores) if negatives else (np.full(len(scores), _LEAST + 1), np.full(len(scores), -_LEAST - 1))
        return scores, np.maximum(lows, self.cuts[own]) if len(self.cuts) else lows, highs


def _search(tile: _Tile, block: dict, dims: int, rule: Windows, negatives: bool, wanted: np.ndarray) -> list[tuple]:
    """Best rows of a block for the wanted anchors of a tile: (anchor, positive score or null, id, score)."""
    ids, labels = np.array(block["ids"], dtype=np.int64), np.array(block["labels"], dtype=np.int64)
    vectors = np.array(block["vecs"], dtype=np.int64).reshape(len(ids), dims)
    scores = products(tile.vectors[wanted], vectors)
    found = []
    for row, anchor in zip(scores, wanted):
        name = int(tile.ids[anchor])
        values, lows, highs = tile.windows(anchor, rule, negatives)
        usable = labels != tile.labels[anchor] if negatives else (labels == tile.labels[anchor]) & (ids != name)
        most = rule.negatives if negatives else rule.positives
        for value, places in zip(values, best_of_windows(row, ids, usable, lows, highs, most)):
            found += [(name, int(value) if negatives else None, int(ids[k]), int(row[k])) for k in places]
    return found


def _found_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "positive_score", "id", "score"])


def block_tile(block: str = "block"):
    """Number of the tile whose blocks lie around a block."""
    return F.floor(F.col(block) / TILE_BLOCKS)


def search_home(blocks: DataFrame, tiles: DataFrame, dims: int, rule: Windows, negatives: bool) -> DataFrame:
    """Every anchor against the blocks of its own tile."""

    def run(near: pa.Table, own: pa.Table) -> pa.Table:
        found = []
        for row in own.to_pylist():
            tile = _Tile(row, dims)
            for block in near.to_pylist():
                found += _search(tile, block, dims, rule, negatives, np.arange(len(tile.ids)))
        return _found_table(found)

    near = blocks.select(block_tile().alias("tile"), "ids", "labels", "vecs")
    return near.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(run, _FOUND)


def choose_blocks(tiles: DataFrame, pages: DataFrame, n_pages: int, dims: int, rule: Windows, negatives: bool) -> DataFrame:
    """(tile, block, wanted): the blocks that a tile must read, for the anchors at the places ``wanted``.

    A block is needed for an anchor if it holds a fitting label and its bounds reach a window at or above the window's
    cut, the score that an anchor's result is known to reach already. The blocks of the tile itself are left out.
    Below the cut, rows of a block that is read are not passed on either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_tile, out_block, out_wanted = [], [], []
            for row in batch.to_pylist():
                tile, blocks = _Tile(row, dims), np.array(row["blocks"], dtype=np.int64)
                low, high = (np.array(row[c], dtype=np.int64).reshape(len(blocks), dims) for c in ("low", "high"))
                least, greatest = interval_bounds(tile.vectors, low, high)
                sizes = np.array(row["kind_sizes"])
                kind_of, kinds = np.repeat(np.arange(len(blocks)), sizes), np.array(row["kinds"], dtype=np.int64)
                here = np.zeros((len(tile.ids), len(blocks)), dtype=bool)
                for anchor in range(len(tile.ids)):
                    fits = kinds != tile.labels[anchor] if negatives else kinds == tile.labels[anchor]
                    reach = np.bincount(kind_of[fits], minlength=len(blocks)) > 0
                    _, lows, highs = tile.windows(anchor, rule, negatives)
                    open_ = (greatest[anchor][:, None] >= lows) & (least[anchor][:, None] <= highs) & (lows <= highs)
                    here[anchor] = reach & open_.any(axis=1)
                here[:, blocks // TILE_BLOCKS == row["tile"]] = False
                for k in np.flatnonzero(here.any(axis=0)):
                    out_tile.append(row["tile"])
                    out_block.append(int(blocks[k]))
                    out_wanted.append(np.flatnonzero(here[:, k]).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_tile, pa.int64()), pa.array(out_block, pa.int64()), pa.array(out_wanted, pa.list_(pa.int32()))],
                names=["tile", "block", "wanted"])

    copies = max(-(-tiles.count() // PAGE_TILES), 1)  # so that a page meets a bounded number of tiles in one task
    visits = tiles.withColumns({
        "page": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))),
        "copy": F.pmod(F.xxhash64("tile"), F.lit(copies)).cast("int")})
    copied = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return visits.join(copied, ["page", "copy"]).select(*tiles.columns, *pages.columns).mapInArrow(run, "tile long, block long, wanted array<int>")


def search_chosen(blocks: DataFrame, tiles: DataFrame, chosen: DataFrame, dims: int, rule: Windows, negatives: bool) -> DataFrame:
    """The chosen blocks against the tiles that need them; a block meets some tiles at a time."""

    def run(block: pa.Table, visitors: pa.Table) -> pa.Table:
        found, held = [], block.to_pylist()[0]
        for row in visitors.to_pylist():
            found += _search(_Tile(row, dims), held, dims, rule, negatives, np.array(row["wanted"]))
        return _found_table(found)

    visits = chosen.withColumn("visit", F.row_number().over(Window.partitionBy("block").orderBy("tile"))).withColumn(
        "turn", F.floor(F.col("visit") / TILES_TOGETHER)).drop("visit")
    visits = materialize(visits)
    turns = visits.select(F.col("block").alias("read"), F.col("turn").alias("time")).distinct()
    payload = turns.join(blocks.select(F.col("block").alias("read"), "ids", "labels", "vecs"), "read")
    return payload.groupBy("read", "time").cogroup(visits.join(tiles, "tile").groupBy("block", "turn")).applyInArrow(run, _FOUND)


def best_rows(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best rows by key, by score downwards, then id, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def with_cuts(tiles: DataFrame, home: DataFrame, rule: Windows, negatives: bool) -> DataFrame:
    """Tiles whose cuts are the scores that the results from the blocks at home reach already."""
    most = rule.negatives if negatives else rule.positives
    keys = ["anchor", "positive_score"] if negatives else ["anchor"]
    reached = best_rows(home, keys, most).filter(F.col("rank") == most)
    anchors = tiles.select("tile", F.posexplode("ids").alias("place", "anchor"), "scores", "sizes")
    if negatives:
        begins = F.aggregate(F.slice("sizes", 1, F.col("place")), F.lit(0), lambda a, b: a + b)
        windows = anchors.select("tile", "place", "anchor", F.posexplode(F.slice("scores", begins + 1, F.get("sizes", F.col("place")))).alias("at", "positive_score"))
        joined = windows.join(reached.select(*keys, "score"), keys, "left")
        least = F.expr(f"{rule.low} * positive_score div {rule.scale} - 1")  # at or just below the window's end
    else:
        joined = anchors.withColumn("at", F.lit(0)).join(reached.select(*keys, "score"), keys, "left")
        least = F.lit(_LEAST + 1)
    cuts = joined.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("place", "at", F.coalesce("score", least).alias("cut")))).alias("_c"))
    return tiles.drop("cuts").join(cuts, "tile", "left").select(
        "*", F.coalesce(F.col("_c.cut"), F.array().cast("array<long>")).alias("cuts")).drop("_c")


def one_round(blocks: DataFrame, tiles: DataFrame, pages: DataFrame, n_pages: int, dims: int, rule: Windows, negatives: bool) -> DataFrame:
    """Best rows of every anchor (or of every window of an anchor) over all blocks."""
    home = materialize(search_home(blocks, tiles, dims, rule, negatives))
    cut = materialize(with_cuts(tiles, home, rule, negatives))
    chosen = materialize(choose_blocks(cut, pages, n_pages, dims, rule, negatives))
    found = home.unionByName(search_chosen(blocks, cut, chosen, dims, rule, negatives))
    keys, most = (["anchor", "positive_score"], rule.negatives) if negatives else (["anchor"], rule.positives)
    return best_rows(found, keys, most)


def usable_rows(df: DataFrame, item: str, label: str, vector: str, anchor) -> DataFrame:
    """(id, label, vec, anchor): rows with an id, a label and a vector without null components.

    Rows that share an id are one row, the one with the least label and then the least vector.
    """
    rows = df.select(
        F.col(item).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vec"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").filter(~F.exists("vec", lambda v: v.isNull()))
    least = F.min(F.struct("label", "vec", "anchor")).alias("_r")
    return rows.groupBy("id").agg(least).select("id", "_r.label", "_r.vec", "_r.anchor")


def hard_negatives(
    df: DataFrame, item: str, label: str, vector: str, anchor, rule: Windows = Windows(), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for every anchor and positive with a negative.

    ``vector`` holds integers; a row's score is its inner product with the anchor, a shorter vector counting as filled up
    with zeros. ``anchor`` marks the rows that are anchors. Positives are an anchor's first ``rule.positives`` other rows
    of its label, negatives of a positive the first ``rule.negatives`` rows of other labels inside its window; higher
    scores come first, ties by the smaller id. Rows without id, label or vector, or with null components, take no part;
    rows that share an id are one (``usable_rows``). Scores must fit 64 bits. Other columns are not looked at; an empty
    table has no result. All rows are searched: the bounds leave out only blocks that cannot change a result.
    """
    spark = df.sparkSession
    rows = materialize(usable_rows(df, item, label, vector, anchor))
    size = rows.agg(
        F.max(F.size("vec")).alias("dims"),
        F.avg(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v) / F.greatest(F.size("vec"), F.lit(1))).alias("square"),
    ).first()
    dims, scale = int(size.dims or 0), float(max(size.square or 0, 1)) ** 0.5
    filled = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vec"))))
    placed = materialize(curve_order(filled, dims, scale))
    blocks = materialize(pack_blocks(placed.repartitionByRange("curve", "id").sortWithinPartitions("curve", "id").drop("curve"), dims, block_rows))
    pages = materialize(zone_pages(blocks))
    n_pages = max(pages.count(), 1)

    packed = _pack_tiles(blocks, dims)
    tiles = materialize(packed)
    positives = materialize(one_round(blocks, tiles, pages, n_pages, dims, rule, False).select("anchor", "id", "score"))
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), False).alias("scores"))
    windows = materialize(_tile_windows(tiles, scores))
    negatives = one_round(blocks, windows, pages, n_pages, dims, rule, True)
    pairs = positives.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return pairs.join(negatives, ["anchor", "positive_score"]).select(
        "anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score"))


def _pack_tiles(blocks: DataFrame, dims: int) -> DataFrame:
    """Tiles of the anchors of neighbouring blocks, with one open window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, ids, labels, anchors, vecs in zip(*(batch.column(k).to_pylist() for k in range(5))):
                kept = np.flatnonzero(np.array(anchors, dtype=bool))
                rows = np.array(vecs, dtype=np.int64).reshape(len(ids), dims)[kept]
                lists = [np.array(ids, dtype=np.int64)[kept], np.array(labels, dtype=np.int64)[kept], rows.ravel()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile], pa.int64()), *[_lists(v, np.array([len(v)]), pa.int64()) for v in lists]], names=["tile", "ids", "labels", "vecs"])

    with_anchor = blocks.filter(F.exists("anchors", lambda a: a)).select(block_tile().alias("tile"), "ids", "labels", "anchors", "vecs")
    parts = with_anchor.mapInArrow(run, "tile long, ids array<long>, labels array<long>, vecs array<long>")
    held = parts.groupBy("tile").agg(F.collect_list(F.struct("ids", "labels", "vecs")).alias("_p"))  # at most TILE_BLOCKS parts
    tiles = held.select("tile", *[F.flatten(f"_p.{c}").alias(c) for c in ("ids", "labels", "vecs")])
    return tiles.withColumns({
        "scores": F.transform("ids", lambda _: F.lit(0).cast("long")), "sizes": F.transform("ids", lambda _: F.lit(1)),
        "cuts": F.transform("ids", lambda _: F.lit(_LEAST + 1).cast("long"))})


def _tile_windows(tiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Tiles whose anchors carry their distinct positive scores; an anchor without positives has none."""
    anchors = tiles.select("tile", F.posexplode("ids").alias("place", "anchor"))
    own = anchors.join(scores, "anchor", "left").groupBy("tile").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("scores", F.array().cast("array<long>")).alias("scores")))).alias("_s"))
    return tiles.select("tile", "ids", "labels", "vecs").join(own, "tile").select(
        "tile", "ids", "labels", "vecs", F.flatten("_s.scores").alias("scores"), F.transform("_s.scores", F.size).alias("sizes"),
        F.array().cast("array<long>").alias("cuts"))
