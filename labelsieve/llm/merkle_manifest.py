"""A Merkle manifest of a dataset with a proof for every row, by octopus multiproofs.

Rows become leaves; the leaves of a source, in the order of their ids, form a ternary tree, and the roots of the sources
form another one above them. Leaves are dealt into partitions: aligned stretches of a large source, or several
neighbouring small sources. The nodes above the stretches are computed once, level by level, into a table of node
coordinates (tree, level, index). A partition then lists the union of the coordinates that the proofs of all its leaves
need and that its own leaves do not determine, at most four a level; they are fetched in one join, the interior nodes
that its proofs share are derived once, and each leaf's proof is expanded where its leaf is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.operators.ranking import join_null_safe, ordered_rank
from labelsieve.session import materialize

ARITY = 3
#: Levels inside a leaf partition; it holds at most ARITY ** SPAN_LEVELS leaves of a large source.
SPAN_LEVELS = 6
TOP = -1  # the tree above the sources; a source's tree has the source's place in the order as its number
PART = ["part", "stretch"]
NODE = "tree long, level int, index long, digest string, size long"
COORDINATES = ["tree", "level", "index"]


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 over the values one after another: ``-`` for null, else length in UTF-8 bytes, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def missing(first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, index) that proofs of the nodes ``first`` .. ``last`` of a level of ``size`` nodes need and
    that these nodes do not determine. Levels count from 0 at the given nodes."""
    level = 0
    while size > 1:
        low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, size)
        yield from ((level, i) for i in range(low, first))
        yield from ((level, i) for i in range(last + 1, high))
        first, last, size, level = first // ARITY, last // ARITY, -(-size // ARITY), level + 1


def climb(digests: list[str], first: int, size: int, fetched: Callable[[int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """Whole runs of siblings on every level above some neighbouring nodes, as (index of the first, digests), and the root."""
    levels, level = [], 0
    while size > 1:
        last = first + len(digests) - 1
        low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, size)
        row = [fetched(level, i) for i in range(low, first)] + digests + [fetched(level, i) for i in range(last + 1, high)]
        levels.append((low, row))
        digests = [digest_of(row[k:k + ARITY]) for k in range(0, len(row), ARITY)]
        first, size, level = low // ARITY, -(-size // ARITY), level + 1
    return levels, digests[0]


def runs_above(levels: list[tuple[int, list[str]]], index: int) -> list[tuple[list[str], list[str]]]:
    """By level the siblings left and right of the node on the way up from ``index``."""
    found = []
    for low, row in levels:
        begin, at = index // ARITY * ARITY - low, index - low
        found.append((row[begin:at], row[at + 1:begin + ARITY]))
        index //= ARITY
    return found


def fold(digest: str, runs: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in runs:
        digest = digest_of([*left, digest, *right])
    return digest


def _rows(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(column, schema.field(name).type) for name, column in zip(names, columns)], names=names)


_NODES = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])


def lowest_nodes(placed: DataFrame, span_levels: int) -> DataFrame:
    """By partition: the node above its stretch of a large source, or the roots of its small sources."""

    def run(leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by([("r", "ascending"), ("pos", "ascending")])
        sources, digests, sizes = (leaves[c].to_pylist() for c in ("r", "leaf", "n"))
        found, begin = [], 0
        large = leaves["part"][0].as_py() >= 0
        for end in range(1, len(sources) + 1):
            if end < len(sources) and sources[end] == sources[begin]:
                continue
            held = digests[begin:end]
            if large:
                for _ in range(span_levels):
                    held = [digest_of(held[k:k + ARITY]) for k in range(0, len(held), ARITY)]
                found.append((sources[begin], span_levels, leaves["stretch"][0].as_py(), held[0], sizes[begin]))
            else:
                found.append((TOP, 0, sources[begin], climb(held, 0, len(held), None)[1], 0))
            begin = end
        return _rows(_NODES.names, found, _NODES)

    return placed.select(*PART, "r", "pos", "n", "leaf").groupBy(*PART).applyInArrow(run, NODE)


def grow(nodes: DataFrame, level: int, span_levels: int) -> list[DataFrame]:
    """All nodes above the nodes of one level, in tables of a few levels each; ``size`` is the number of a tree's leaves."""
    grown = []
    frontier = nodes

    def climb_some(base: int) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("index")
            tree, leaves, first = (group[c][0].as_py() for c in ("tree", "size", "index"))
            held, found = group["digest"].to_pylist(), []
            size = -(-leaves // ARITY ** base)
            for step in range(1, span_levels + 1):
                if size == 1:
                    break
                held = [digest_of(held[k:k + ARITY]) for k in range(0, len(held), ARITY)]
                first, size = first // ARITY, -(-size // ARITY)
                found += [(tree, base + step, first + k, digest, leaves) for k, digest in enumerate(held)]
            return _rows(_NODES.names, found, _NODES)
        return run

    while not frontier.isEmpty():
        stretch = F.floor(F.col("index") / ARITY ** span_levels)
        above = materialize(frontier.groupBy("tree", stretch.alias("_stretch")).applyInArrow(climb_some(level), NODE))
        grown.append(above)
        level += span_levels
        frontier = above.filter(F.col("level") == level)
    return grown


def is_root(column: Column, size: Column) -> Column:
    """A tree's node is its root if the tree has one node on its level."""
    return size <= F.pow(F.lit(float(ARITY)), column)


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def place_leaves(leaves: DataFrame, span_levels: int) -> tuple[DataFrame, int]:
    """Leaves with r (place of the source), n (its leaves), pos (place in the source) and their partition; number of sources.

    Sources come in the order of their UTF-8 bytes, null first; ids ascend, null first; rows that share an id come in the
    order of their digests. A source of more than a stretch has partitions of its own, each a stretch; smaller sources
    that begin in the same stretch of all leaves share one.
    """
    span = ARITY ** span_levels
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("changed").asc_nulls_first()]
    ranked = ordered_rank(leaves, order, "overall")
    sizes = ranked.groupBy("source").agg((F.min("overall") - 1).alias("first"), F.count("*").alias("n"))
    sources = materialize(ordered_rank(sizes, [F.col("first")], "r").withColumn("r", F.col("r") - 1))
    placed = join_null_safe(ranked, sources, ["source"]).withColumn("pos", F.col("overall") - 1 - F.col("first"))
    large = F.col("n") > span
    return materialize(placed.withColumns({
        "part": F.when(large, F.col("r")).otherwise(-F.floor(F.col("first") / span) - 1),
        "stretch": F.when(large, F.floor(F.col("pos") / span)).otherwise(F.lit(0)).cast("long"),
    }).drop("overall", "first")), sources.count()


def needed_coordinates(placed: DataFrame, n_sources: int, span_levels: int) -> DataFrame:
    """(part, stretch, tree, level, index): the union of what the proofs of a partition's leaves need from elsewhere."""
    parts = placed.groupBy(*PART).agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.max("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, stretch, r1, r2, n in zip(*(column.to_pylist() for column in batch.columns)):
                if part >= 0:
                    size = -(-n // ARITY ** span_levels)
                    rows += [(part, stretch, r1, span_levels + level, i) for level, i in missing(stretch, stretch, size)]
                rows += [(part, stretch, TOP, level, i) for level, i in missing(r1, r2, n_sources)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*PART, *COORDINATES])

    return parts.mapInArrow(run, "part long, stretch long, tree long, level int, index long")


def expand(leaves: pa.Table, fetched: pa.Table, n_sources: int) -> pa.Table:
    """Proofs of one partition's leaves, from the leaves and the fetched nodes."""
    known = dict(zip(zip(*(fetched[c].to_pylist() for c in COORDINATES)), fetched["digest"].to_pylist()))
    leaves = leaves.sort_by([("r", "ascending"), ("pos", "ascending")])
    sources, at, sizes, digests, changed = (leaves[c].to_pylist() for c in ("r", "pos", "n", "leaf", "changed"))
    trees, begin = [], 0
    for end in range(1, len(sources) + 1):
        if end < len(sources) and sources[end] == sources[begin]:
            continue
        r = sources[begin]
        levels, root = climb(digests[begin:end], at[begin], sizes[begin], lambda level, i, r=r: known[(r, level, i)])
        trees.append((begin, end, levels, root))
        begin = end
    top, root = climb([tree[3] for tree in trees], sources[0], n_sources, lambda level, i: known[(TOP, level, i)])
    out: dict[str, list] = {"subroot": [], "proof_sha256": [], "folded_root": []}
    for place, (begin, end, levels, subroot) in enumerate(trees):
        shared = runs_above(top, sources[0] + place)
        tail = "".join(digest for left, right in shared for digest in (*left, *right))
        for k in range(begin, end):
            own = runs_above(levels, at[k])
            proof = "".join(digest for left, right in own for digest in (*left, *right)) + tail
            out["subroot"].append(subroot)
            out["proof_sha256"].append(digest_of([proof]))
            folded = fold(digests[k] if changed[k] is None else changed[k], own)
            out["folded_root"].append(root if folded == subroot else fold(folded, shared))
    return pa.table({
        "source": leaves["source"], "id": leaves["id"], "leaf": leaves["leaf"], "subroot": pa.array(out["subroot"], pa.string()),
        "root": pa.array([root] * len(sources), pa.string()), "proof_sha256": pa.array(out["proof_sha256"], pa.string()),
        "folded_root": pa.array(out["folded_root"], pa.string())})


def manifest(
    docs: DataFrame, item: str, source: str, leaf: Column, changed: Column, span_levels: int = SPAN_LEVELS,
) -> DataFrame:
    """(source, id, leaf, subroot, root, proof_sha256, folded_root): one row per row of ``docs``.

    ``leaf`` is a row's digest (``leaf_digest``); ``changed`` the digest to check against the tree instead, null for the
    leaf itself. ``proof_sha256`` is the digest of the row's siblings, level by level to the root of its source and on to
    the root of all, left to right; ``folded_root`` is what the checked digest and these siblings give. Null is a source
    of its own and comes first; null ids come first; repeated rows are leaves of their own; columns beyond those that the
    expressions use do not matter. ``span_levels`` sizes the leaf partitions and changes no result. An empty table has no rows, and no root.
    """
    leaves = materialize(docs.select(
        F.col(source).cast("string").alias("source"), F.col(item).alias("id"), leaf.alias("leaf"), changed.alias("changed")))
    placed, n_sources = place_leaves(leaves, span_levels)
    lowest = materialize(lowest_nodes(placed, span_levels))
    inside = [lowest.filter(F.col("tree") != TOP), *grow(lowest.filter(F.col("tree") != TOP), span_levels, span_levels)]
    roots = united(inside).filter(is_root(F.col("level"), F.col("size"))).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("index"), "digest",
        F.lit(n_sources).cast("long").alias("size"))
    small = lowest.filter(F.col("tree") == TOP).withColumn("size", F.lit(n_sources).cast("long"))
    subroots = materialize(small.unionByName(roots))
    nodes = united([*inside, subroots, *grow(subroots, 0, span_levels)])
    fetched = needed_coordinates(placed, n_sources, span_levels).join(nodes.drop("size"), COORDINATES)
    kinds = {field.name: field.dataType for field in placed.schema.fields}
    schema = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in (
        "source", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root")])
    leaves_by_part = placed.select(*PART, "r", "pos", "n", "source", "id", "leaf", "changed").groupBy(*PART)
    return leaves_by_part.cogroup(fetched.groupBy(*PART)).applyInArrow(lambda a, b: expand(a, b, n_sources), schema)
