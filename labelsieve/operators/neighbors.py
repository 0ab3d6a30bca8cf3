"""Cosine k-nearest-neighbour join.

Exact search without a pair table. Equal vectors are merged first, so a huge group of copies costs one vector. The
distinct vectors are spread over cells around hash-sampled pivots, and each cell is cut into blocks of bounded size.
A block finds the neighbours inside itself; that gives every vector an upper bound, and by the triangle inequality it
is sent only to the cells that can hold something nearer. Visitors meet the blocks of a cell in a cogroup, and only the
best k per vector leave it. Blocks grow with the input up to a bound, so that a vector which has to see all others is sent to
a fixed number of blocks and not to ever more of them. With ``probes`` the cells to visit are the nearest pivots instead: approximate, for large
inputs, with every vector still getting its k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.functions.vectors import as_doubles
from labelsieve.operators.checks import union_all
from labelsieve.schema import NEIGHBORS
from labelsieve.session import materialize, small_table

DECIMALS = 9  # distances are compared at this resolution, so summation order cannot reorder ties
BLOCK_BYTES = 1 << 20
EXACT_TILES = 8  # an exact search cuts the vectors into about this many blocks ...
EXACT_BLOCK_BYTES = 32 << 20  # ... until they reach this size
PIVOT_LIMIT = 1 << 15
PIVOT_BYTES = 64 << 20
TABLE_CELLS = 1 << 22  # distance tables are made in slices of at most this many numbers
SLACK = 1e-6
APPROXIMATE_PROBES = 8
CANDIDATES = "array<struct<distance:double,neighbor_id:bigint,neighbor_label:bigint>>"
PACKED = "cell int, block int, rows int, keys binary, matrix binary, ids binary, labels binary, bound binary"
ROUTED = "m_cell int, rows int, keys binary, matrix binary, bound binary"
TURN_ROWS = 1 << 14
PACK_ROWS = 1 << 12
FOUND = "v1 bigint, v2 bigint, distance double, neighbor_id bigint, neighbor_label bigint"


class Cells(NamedTuple):
    """Pivots as unit rows, and of each pivot's cell the radius and the number of items."""

    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _nearest(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, labels: np.ndarray, keep: int, bound: np.ndarray | None = None):
    """(query row, distance, id, label) of the ``keep`` lowest (distance, id) per query; ids padded with -1.

    ``bound``: how far, on the unit sphere, a neighbour of each query can be at most; others are left out.
    """
    parts = [_nearest_slice(queries[part], members, ids, labels, keep, None if bound is None else bound[part], part.start)
             for part in _slices(len(queries), len(members))]
    return tuple(np.concatenate(side) for side in zip(*parts))


def _nearest_slice(queries, members, ids, labels, keep: int, bound: np.ndarray | None, first: int):
    similarity = queries @ members.T
    if bound is not None and np.isfinite(bound).all():
        row, col = np.nonzero(similarity >= (1.0 - (bound + SLACK) ** 2 / 2 - SLACK)[:, None])
    elif members.shape[0] > keep:
        distance = np.round(np.clip(1.0 - similarity, 0.0, 2.0), DECIMALS)
        row, col = np.nonzero(distance <= np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep])
    else:
        row, col = (side.ravel() for side in np.indices(similarity.shape))
    distance = np.round(np.clip(1.0 - similarity[row, col], 0.0, 2.0), DECIMALS)
    if bound is not None:
        useful = np.sqrt(2.0 * distance) <= bound[row] + SLACK
        row, col, distance = row[useful], col[useful], distance[useful]
    copies = ids[col]
    real = copies >= 0
    times = real.sum(axis=1)
    row, value = np.repeat(row, times), np.repeat(distance, times)
    item, label = copies[real], labels[col][real]
    order = np.lexsort((item, value, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    best = place < keep
    order = order[best]
    return row[best] + first, value[order], item[order], label[order]


def _slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, TABLE_CELLS // columns)
    return (slice(start, start + step) for start in range(0, rows, step))


def _merge_copies(df: DataFrame, id_col: str, vec_col: str, label_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows with vector key, distinct vectors with their ``keep`` lowest ids). The key is a 128-bit hash."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("code"), F.col(vec_col).alias("vec")
    ).withColumns({"v1": F.xxhash64("vec"), "v2": F.xxhash64(F.lit("vec"), "vec")})
    first = Window.partitionBy("v1", "v2").orderBy("id")
    lowest = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= keep)
    distinct = lowest.groupBy("v1", "v2").agg(
        F.max_by("vec", -F.col("_rn")).alias("vec"),
        F.array_sort(F.collect_list(F.struct("id", "code"))).alias("copies"),
    )
    return rows, distinct


def _place(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of every vector and the distance to it on the unit sphere."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = _unit_rows(batch["vec"])
            cells, nearest = [], []
            for part in _slices(len(matrix), len(pivots)):
                similarity = matrix[part] @ pivots.T
                cells.append(similarity.argmax(axis=1))
                nearest.append(similarity.max(axis=1))
            gap = np.sqrt(np.clip(2.0 - 2.0 * np.concatenate(nearest), 0.0, None))
            yield batch.assign(cell=np.concatenate(cells).astype(np.int32), gap=gap)

    columns = [T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    return df.mapInPandas(place, T.StructType(df.schema.fields + columns))


def _pack(placed: DataFrame, keep: int, kind: type) -> DataFrame:
    """One row per block: its vectors as given, and for each how far its ``keep``-th nearest in the block is.

    Vectors are moved as numbers of ``kind``, the type of the given components, and scaled to unit length where they are
    compared; unit rows would be doubles.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        given = np.stack([np.asarray(v, dtype=kind) for v in group["vec"]])
        matrix = _unit(given)
        ids = np.full((len(group), keep), -1, dtype=np.int64)
        labels = np.zeros((len(group), keep), dtype=np.int64)
        for at, copies in enumerate(group["copies"]):
            ids[at, : len(copies)] = [copy["id"] for copy in copies]
            labels[at, : len(copies)] = [copy["code"] for copy in copies]
        row, distance, _, _ = _nearest(matrix, matrix, ids, labels, keep)
        last = np.searchsorted(row, np.arange(len(group)), side="right") - 1
        full = np.bincount(row, minlength=len(group)) >= keep
        worst = np.full(len(group), np.inf)
        worst[full] = np.sqrt(2.0 * distance[last[full]])
        return pd.DataFrame([{
            "cell": int(group["cell"].iloc[0]), "block": int(group["block"].iloc[0]), "rows": len(group),
            "keys": group[["v1", "v2"]].to_numpy(np.int64).tobytes(), "matrix": given.tobytes(),
            "ids": ids.tobytes(), "labels": labels.tobytes(), "bound": worst.tobytes(),
        }])

    return placed.groupBy("cell", "block").applyInPandas(pack, PACKED)


def _route(blocks: DataFrame, cells: Cells, width: int, keep: int, probes: int | None, kind: type) -> tuple[DataFrame, DataFrame]:
    """(rows by visited cell, packs): the vectors that have to visit a cell, in packs by the block they come from (``ROUTED``).

    Packs are many times the blocks, so they are not written down: the visits are counted first, without the vectors, and
    the packs are made on the way to the cells.

    A vector is sent to the cells that its own bound reaches by the triangle inequality, or, with ``probes``, to its
    nearest ones that hold enough items; what is sent grows with the visits, not with blocks times cells.
    """

    def to_visit(gaps: np.ndarray, worst: np.ndarray) -> np.ndarray:
        if probes is None:
            return (gaps - cells.radius) <= worst[:, None] + SLACK
        ranked = np.argsort(gaps, axis=1, kind="stable")
        reach = np.cumsum(cells.size[ranked], axis=1)
        needed = np.maximum(probes, (reach < keep).sum(axis=1) + 1)
        visit = np.zeros(gaps.shape, dtype=bool)
        np.put_along_axis(visit, ranked, np.arange(gaps.shape[1]) < needed[:, None], axis=1)
        return visit

    def visits(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for block in batch.itertuples(index=False):
                given, bound = np.frombuffer(block.matrix, dtype=kind).reshape(-1, width), np.frombuffer(block.bound)
                keys, matrix = np.frombuffer(block.keys, dtype=np.int64).reshape(-1, 2), _unit(given)
                for part in _slices(len(matrix), max(len(cells.pivots), TABLE_CELLS // PACK_ROWS)):
                    gaps = np.sqrt(np.clip(2.0 - 2.0 * (matrix[part] @ cells.pivots.T), 0.0, None))
                    yield to_visit(gaps, bound[part]), keys[part], given[part], bound[part]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for visit, *_ in visits(batches):
            yield pd.DataFrame({"m_cell": np.arange(visit.shape[1], dtype=np.int32), "rows": visit.sum(axis=0)}).query("rows > 0")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for visit, keys, given, bound in visits(batches):
            for cell in np.flatnonzero(visit.any(axis=0)):
                goes = visit[:, cell]
                yield pd.DataFrame([{
                    "m_cell": int(cell), "rows": int(goes.sum()), "keys": keys[goes].tobytes(),
                    "matrix": given[goes].tobytes(), "bound": bound[goes].tobytes()}])

    sent = blocks.select("keys", "matrix", "bound")
    return sent.mapInPandas(count, "m_cell int, rows long"), sent.mapInPandas(route, ROUTED)


def _blocks(distinct: DataFrame, count: int, width: int, block_rows: int, keep: int, kind: type) -> tuple[DataFrame, Cells]:
    """Packed blocks of at most about ``block_rows`` vectors, in as many cells as full blocks are expected."""
    if count <= block_rows:
        single = distinct.withColumns({"cell": F.lit(0), "block": F.lit(0)})
        return materialize(_pack(single, keep, kind)), Cells(np.zeros((1, width)), np.full(1, np.inf), np.ones(1, dtype=np.int64))
    wanted = min(-(-count // block_rows), PIVOT_LIMIT, max(1, PIVOT_BYTES // (8 * width)))
    sample = distinct.orderBy("v1", "v2").limit(wanted).collect()
    pivots = _unit_rows(pd.Series([row.vec for row in sample]))
    placed = materialize(_place(distinct, pivots))
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("gap").alias("radius"), F.sum(F.size("copies")).alias("ids")
    ).collect()
    radius, size = np.full(wanted, -np.inf), np.zeros(wanted, dtype=np.int64)
    cuts = np.ones(wanted, dtype=np.int64)
    for stat in stats:
        radius[stat.cell], size[stat.cell], cuts[stat.cell] = stat.radius, stat.ids, -(-stat.n // block_rows)
    cut = small_table(
        distinct.sparkSession.createDataFrame([(cell, int(cuts[cell])) for cell in range(wanted)], "cell int, cut int")
    )
    blocks = placed.join(cut, "cell").withColumn("block", F.pmod("v2", "cut").cast("int")).drop("cut")
    return materialize(_pack(blocks, keep, kind)), Cells(pivots, radius, size)


def _search(blocks: DataFrame, counted: DataFrame, routed: DataFrame, keep: int, width: int, kind: type) -> DataFrame:
    """Best ``keep`` of every visited block for every visiting vector; ``counted`` and ``routed`` come from ``_route``.

    Packs of visitors meet the blocks of their cell in a cogroup; a block that many visit is read again for every
    ``TURN_ROWS`` of them, or as many as a block holds, so no group grows with the popularity of a cell. Packs are moved once
    and written nowhere else.
    """
    homes = blocks.select(F.col("cell").alias("m_cell"), F.col("block").alias("m_block"), F.col("rows").alias("held"))
    room = F.greatest(F.max("held"), F.lit(TURN_ROWS))
    visitors = counted.groupBy("m_cell").agg(F.sum("rows").alias("visits"))
    turns = visitors.join(homes.groupBy("m_cell").agg(room.alias("room"), F.collect_list("m_block").alias("m_block")), "m_cell")
    turns = small_table(turns.select("m_cell", F.explode("m_block").alias("m_block"), F.ceil(F.col("visits") / F.col("room")).alias("turns")))
    visits = routed.join(turns, "m_cell").withColumn("turn", F.pmod(F.xxhash64("keys"), "turns"))
    visits = visits.select("m_cell", "m_block", "turn", "keys", "matrix", "bound")
    members = turns.select(F.col("m_cell").alias("t_m_cell"), F.col("m_block").alias("t_m_block"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("t_turn"))
    members = members.join(
        blocks.select(F.col("cell").alias("t_m_cell"), F.col("block").alias("t_m_block"), "matrix", "ids", "labels"), ["t_m_cell", "t_m_block"])

    def search(held: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        if not len(packs):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype({"distance": "float64"})
        block, found = held.iloc[0], []
        members = _unit(np.frombuffer(block["matrix"], dtype=kind).reshape(-1, width))
        ids, labels = (np.frombuffer(block[c], dtype=np.int64).reshape(-1, keep) for c in ("ids", "labels"))
        for pack in packs.itertuples(index=False):
            queries = _unit(np.frombuffer(pack.matrix, dtype=kind).reshape(-1, width))
            row, distance, item, label = _nearest(queries, members, ids, labels, keep, np.frombuffer(pack.bound))
            keys = np.frombuffer(pack.keys, dtype=np.int64).reshape(-1, 2)[row]
            found.append(pd.DataFrame({
                "v1": keys[:, 0], "v2": keys[:, 1], "distance": distance, "neighbor_id": item, "neighbor_label": label}))
        return pd.concat(found)

    return members.groupBy("t_m_cell", "t_m_block", "t_turn").cogroup(visits.groupBy("m_cell", "m_block", "turn")).applyInPandas(search, FOUND)


def _literal_candidates(rows: list) -> Column:
    entries = [
        F.struct(
            F.lit(1.0).alias("distance"), F.lit(row.id).cast("long").alias("neighbor_id"),
            F.lit(row.code).cast("long").alias("neighbor_label"),
        ) for row in rows
    ]
    return F.array(*entries).cast(CANDIDATES)


def neighbor_lists(
    df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = NEIGHBORS,
    probes: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, code, vec, neighbors): the k nearest others by (cosine distance, id), nearest first.

    ``id_col`` is a unique bigint and ``label_col`` an integer code carried along. Fewer than k others give fewer
    neighbours. A zero vector is at distance 1 from everything.
    """
    keep = k + 1  # one spare: the item itself is among the candidates
    norm2 = F.aggregate(as_doubles(F.col(vec_col)), F.lit(0.0), lambda total, v: total + v * v)
    rows, distinct = _merge_copies(df.filter(norm2 > 0), id_col, vec_col, label_col, keep)
    distinct = materialize(distinct)
    shape = distinct.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    count, width = shape.n, shape.width
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("code"),
                      F.col(vec_col).alias("vec"), (norm2 > 0).alias("_nonzero"))
    zeros = plain.filter(~F.col("_nonzero")).orderBy("id").limit(keep).select("id", "code").collect()

    parts = []
    if count:
        block_rows = max(keep, block_bytes // (8 * width))
        if probes is None:
            block_rows = max(block_rows, min(-(-count // EXACT_TILES), EXACT_BLOCK_BYTES // (8 * width)))
        kind = np.float32 if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else np.float64
        blocks, cells = _blocks(distinct, count, width, block_rows, keep, kind)
        found = _search(blocks, *_route(blocks, cells, width, keep, probes, kind), keep, width, kind)
        best = Window.partitionBy("v1", "v2").orderBy("distance", "neighbor_id")
        merged = (
            found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= keep)
            .groupBy("v1", "v2")
            .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id", "neighbor_label"))).alias("near"))
        )
        if zeros:
            near = F.slice(F.array_sort(F.concat("near", _literal_candidates(zeros))), 1, keep)
            merged = merged.withColumn("near", near)
        parts.append(rows.join(merged, ["v1", "v2"]).select("id", "code", "vec", "near"))
    if zeros:
        lowest = plain.orderBy("id").limit(keep).select("id", "code").collect()
        parts.append(
            plain.filter(~F.col("_nonzero")).select("id", "code", "vec", _literal_candidates(lowest).alias("near"))
        )
    if not parts:
        parts = [plain.select("id", "code", "vec", F.array().cast(CANDIDATES).alias("near"))]
    others = F.filter("near", lambda c: c["neighbor_id"] != F.col("id"))
    return union_all(parts).select("id", "code", "vec", F.slice(others, 1, k).alias("neighbors"))


def neighbor_edges(lists: DataFrame) -> DataFrame:
    """(id, neighbor_id, neighbor_label, distance, rank), one row per neighbour."""
    return lists.select("id", F.posexplode("neighbors").alias("_at", "_n")).select(
        "id", "_n.neighbor_id", "_n.neighbor_label", "_n.distance", (F.col("_at") + 1).cast("long").alias("rank")
    )


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact edges that the approximate search also found."""
    hits = exact.select("id", "neighbor_id").join(
        approximate.select("id", "neighbor_id", F.lit(1).alias("_hit")), ["id", "neighbor_id"], "left"
    )
    return hits.agg(
        F.count("*").cast("long").alias("edges"), (F.count("_hit") / F.count("*")).alias("recall")
    )
