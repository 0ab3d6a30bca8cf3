"""Text probabilities by context-tree weighting over bytes.

A text is modelled as its lower-cased words with one space between them and a line feed at the end. Every byte is eight
binary decisions along a tree of bit prefixes (nodes); each node has a context tree of its own over the bytes before.
Counts of byte n-grams are gathered from all training texts. In each context and node the Krichevsky-Trofimov estimate
of the counts is weighted against the product of the longer contexts, from the longest up; the resulting weights mix the
estimates of all depths into one probability for each byte. What a context has never been followed by shares the
probability that the context leaves over, in proportion to the next shorter context; a context never met adds nothing.
Scoring sends a table of frequent n-grams to the tasks; n-grams that are not in it meet the whole table in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.blocks import Block, Words, by_row, find_words, text_blocks, with_text_columns
from labelsieve.session import materialize

DEPTH = 5
MOST_GRAMS = 3_000_000  # sent to the tasks; the others are joined
COUNT_BYTES = 2 << 20  # of text counted at a time; the arrays of its grams take about sixty times as much
END, SPACE = 10, 32
_LOG_PI = float(np.log(np.pi))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight, for positive numbers."""
    x = np.asarray(x, dtype=np.float64)
    product = np.ones_like(x)
    for k in range(8):
        product *= np.where(x < 1e6, x + k, 1.0)
    z = np.where(x < 1e6, x + 8, x)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - _LOG_PI


def canonical_bytes(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds by text): the words of each text with one space between them and a line feed at the end."""
    starts, sizes, rows = words.starts, words.ends - words.starts, words.rows
    n = block.last - block.first
    empty = np.flatnonzero(np.diff(words.bounds) == 0)
    if len(empty):
        rows = np.concatenate([rows, empty])
        order = np.argsort(rows, kind="stable")
        starts, sizes, rows = np.concatenate([starts, empty * 0])[order], np.concatenate([sizes, empty * 0])[order], rows[order]
    lengths = sizes + 1
    ends = np.cumsum(lengths)
    source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)
    out = block.data[np.minimum(source, max(len(block.data) - 1, 0))] if len(block.data) else np.zeros(len(source), dtype=np.uint8)
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = rows[1:] != rows[:-1]
    out[ends - 1] = np.where(last, END, SPACE)
    return out, np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(n + 1))]


def grams_of(data: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """At each position the byte and, above it, the ``depth`` bytes before it; before a text there are line feeds."""
    grams = data.astype(np.int64)
    first = bounds[:-1]
    for k in range(1, depth + 1):
        before = np.empty(len(data), dtype=np.int64)
        before[k:] = data[:len(data) - k]
        for j in range(k):  # the j-th byte of a text has fewer than k before it
            at = first + j
            before[at[at < bounds[1:]]] = END
        grams |= before << np.int64(8 * k)
    return grams


def gram_counts(texts: pa.Array, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and their numbers, by blocks of texts."""
    for block in text_blocks(texts, COUNT_BYTES, 1 << 20):
        data, bounds = canonical_bytes(block, find_words(block))
        grams = grams_of(data, bounds, depth)
        grams.sort()
        begins = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        yield grams[begins], np.diff(np.append(begins, len(grams)))


def count_grams(texts: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """(gram, n): byte n-grams of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, counts in gram_counts(batch.column(0), depth):
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    return texts.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one depth: grams (context and byte) with counts, and nodes (context and bit prefix) with estimates."""

    grams: np.ndarray
    counts: np.ndarray
    nodes: np.ndarray  # context * 256 + node, sorted
    zeros: np.ndarray
    ones: np.ndarray
    log_beta: np.ndarray
    log_weighted: np.ndarray


def node_of(byte: np.ndarray, bit: int) -> np.ndarray:
    return (1 << bit) | (byte >> (8 - bit))


def weigh(grams: np.ndarray, counts: np.ndarray, deepest: int, shallowest: int) -> dict[int, Level]:
    """Levels of a set of grams that is complete for its shortest contexts, from the longest contexts up."""
    levels: dict[int, Level] = {}
    for depth in range(deepest, shallowest - 1, -1):
        grams, at = np.unique(grams & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        counts = np.bincount(at, weights=counts, minlength=len(grams))
        context, byte = grams >> 8, grams & 255
        keys = np.concatenate([context * 256 + node_of(byte, bit) for bit in range(8)])
        ones = np.concatenate([(byte >> (7 - bit)) & 1 for bit in range(8)])
        nodes, at = np.unique(keys, return_inverse=True)
        repeated = np.tile(counts, 8)
        b = np.bincount(at, weights=repeated * ones, minlength=len(nodes))
        a = np.bincount(at, weights=repeated * (1 - ones), minlength=len(nodes))
        own = log_estimate(a, b)
        if depth == deepest:
            log_beta, log_weighted = np.full(len(nodes), np.inf), own
        else:
            below = levels[depth + 1]
            parent = ((below.nodes >> 8) & ((1 << (8 * depth)) - 1)) * 256 + (below.nodes & 255)
            product = np.bincount(np.searchsorted(nodes, parent), weights=below.log_weighted, minlength=len(nodes))
            log_beta, log_weighted = own - product, np.logaddexp(own, product) - np.log(2)
        levels[depth] = Level(grams, counts, nodes, a, b, log_beta, log_weighted)
    return levels


def mix_upwards(levels: dict[int, Level], grams: np.ndarray, depth: int, shallowest: int, above) -> np.ndarray:
    """Natural logarithm of each gram's byte after its context of ``depth`` bytes; ``above`` mixes in shorter contexts."""
    context, byte = grams >> 8, grams & 255
    total = np.zeros(len(grams))
    for bit in range(8):
        node, one = node_of(byte, bit), (byte >> (7 - bit)) & 1
        p = None
        for d in range(depth, shallowest - 1, -1):
            level = levels[d]
            at = np.searchsorted(level.nodes, (context & ((1 << (8 * d)) - 1)) * 256 + node)
            own = (np.where(one, level.ones[at], level.zeros[at]) + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            p = own if p is None else blend(own, level.log_beta[at], p)
        total += np.log(above(context, node, one, p))
    return total


def blend(own: np.ndarray, log_beta: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    weight = 1 / (1 + np.exp(-np.clip(log_beta, -40, 40)))
    return weight * own + (1 - weight) * deeper


@dataclass
class Upper:
    """The root's nodes and those of the 256 contexts of one byte: at most 257 x 256 numbers each."""

    zeros: np.ndarray
    ones: np.ndarray
    log_beta: np.ndarray

    def estimate(self, row: np.ndarray, node: np.ndarray, one: np.ndarray) -> np.ndarray:
        a, b = self.zeros[row, node], self.ones[row, node]
        return (np.where(one, b, a) + 0.5) / (a + b + 1)

    def above(self, context: np.ndarray, node: np.ndarray, one: np.ndarray, p) -> np.ndarray:
        """Mix in the context of one byte and the root; without ``p`` start at the context of one byte."""
        row = (context & 255) + 1
        own = self.estimate(row, node, one)
        p = own if p is None else blend(own, self.log_beta[row, node], p)
        root = np.zeros_like(row)
        return blend(self.estimate(root, node, one), self.log_beta[root, node], p)


def upper_levels(summaries: DataFrame) -> Upper:
    """From (context of two bytes, node, zeros, ones, log_weighted): the levels of one byte and of none."""
    sums = summaries.groupBy((F.col("context") % 256).alias("c1"), "node").agg(
        F.sum("zeros").alias("a"), F.sum("ones").alias("b"), F.sum("log_weighted").alias("w")).toPandas()
    zeros, ones, below = np.zeros((257, 256)), np.zeros((257, 256)), np.zeros((257, 256))
    c, z = sums["c1"].to_numpy(dtype=np.int64) + 1, sums["node"].to_numpy(dtype=np.int64)
    zeros[c, z], ones[c, z], below[c, z] = sums["a"], sums["b"], sums["w"]
    zeros[0], ones[0] = zeros[1:].sum(axis=0), ones[1:].sum(axis=0)
    own = log_estimate(zeros, ones)
    below[0] = (np.logaddexp(own[1:], below[1:]) - np.log(2)).sum(axis=0)
    return Upper(zeros, ones, own - below)


def table_rows(levels: dict[int, Level], deepest: int, upper: Upper) -> Iterator[pd.DataFrame]:
    """(depth, gram, value, size): log10 of each gram's byte, with gram -1 - context for what a context leaves over."""
    shorter = None
    for depth in range(2, deepest + 1):
        level = levels[depth]
        value = mix_upwards(levels, level.grams, depth, 2, upper.above)
        context = level.grams >> 8
        distinct, at = np.unique(context, return_inverse=True)
        size = np.bincount(at, weights=level.counts)
        if depth == 2:
            less = sum_one_byte(upper, level.grams)
        else:
            below = levels[depth - 1].grams
            less = shorter[np.searchsorted(below, level.grams & ((1 << (8 * depth)) - 1))]
        left = np.maximum(1 - np.bincount(at, weights=np.exp(value)), 1e-12)
        room = np.maximum(1 - np.bincount(at, weights=np.exp(less)), 1e-12)
        yield pd.DataFrame({
            "depth": depth, "gram": np.concatenate([level.grams, -1 - distinct]),
            "value": np.concatenate([value, np.log(left) - np.log(room)]) / np.log(10), "size": np.concatenate([level.counts, size])})
        shorter = value


def sum_one_byte(upper: Upper, grams: np.ndarray) -> np.ndarray:
    context, byte = (grams >> 8) & 255, grams & 255
    total = np.zeros(len(grams))
    for bit in range(8):
        total += np.log(upper.above(context, node_of(byte, bit), (byte >> (7 - bit)) & 1, None))
    return total


class Slots:
    """A hash table of distinct non-negative keys, for looking up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.5))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = self.place(keys[left], self.probes)
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at[taken]], self.values[at[taken]] = keys[left[taken]], values[left[taken]]
            left = np.delete(left, taken)
            self.probes += 1

    def place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        hashed = (keys.view(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)
        return (hashed.view(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether they are there)."""
        at = self.place(keys, 0)
        found = self.keys[at] == keys
        values = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (self.keys[at] != _EMPTY))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = self.place(keys[left], probe)
            here = self.keys[at] == keys[left]
            values[left[here]], found[left[here]] = self.values[at[here]], True
            left = left[~here & (self.keys[at] != _EMPTY)]
        return values, found


@dataclass
class ContextTree:
    """Scoring tables: by depth, grams and what contexts leave over; all bytes after each single byte.

    If ``whole`` is None they are complete; else ``grams`` holds frequent grams of the full depth alone and ``whole`` (near,
    depth, gram, value) everything, ``near`` being the two nearest bytes.
    """

    depth: int
    single: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    left: dict[int, tuple[np.ndarray, np.ndarray]]
    whole: DataFrame | None = None


def fit(texts: DataFrame, text: str, depth: int = DEPTH, most_grams: int = MOST_GRAMS) -> ContextTree:
    """Learn from all texts.

    The table that scoring sends to the tasks holds at most ``most_grams`` entries: if there are more, it holds the grams of
    the full depth that occurred most often (by powers of two), and ``score`` joins the others, so scores do not depend on
    the bound. An empty training table gives every byte the same probability. ``depth`` is 2 to 6.
    """
    grams = materialize(count_grams(texts, text, depth))
    spark = grams.sparkSession
    keyed = grams.withColumn("context", F.shiftright("gram", 8).bitwiseAND(0xFFFF))

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        level = weigh(frame["gram"].to_numpy(), frame["n"].to_numpy(), depth, 2)[2]
        return pd.DataFrame({
            "context": level.nodes >> 8, "node": level.nodes & 255, "zeros": level.zeros, "ones": level.ones, "log_weighted": level.log_weighted})

    upper = upper_levels(keyed.groupBy("context").applyInPandas(
        summarise, "context long, node long, zeros double, ones double, log_weighted double"))
    sent = spark.sparkContext.broadcast((upper.zeros, upper.ones, upper.log_beta))

    def tabulate(frame: pd.DataFrame) -> pd.DataFrame:
        levels = weigh(frame["gram"].to_numpy(), frame["n"].to_numpy(), depth, 2)
        return pd.concat(list(table_rows(levels, depth, Upper(*sent.value))))

    rows = materialize(keyed.groupBy("context").applyInPandas(tabulate, "depth int, gram long, value double, size double"))
    table, whole = rows, None
    if rows.count() > most_grams:
        context = F.when(F.col("gram") >= 0, F.shiftright("gram", 8)).otherwise(-1 - F.col("gram"))
        whole = rows.select(context.bitwiseAND(0xFFFF).alias("near"), "depth", "gram", F.col("value").cast("float").alias("value"))
        full = rows.filter((F.col("depth") == depth) & (F.col("gram") >= 0))
        sizes = full.groupBy(F.floor(F.log2("size")).alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()
        least, total = 0.0, 0
        for row in sizes:
            total += row.n
            if total > most_grams:
                least = 2.0 ** (row.power + 1)
                break
        table = full.filter(F.col("size") >= least)
    table = table.select("depth", "gram", F.col("value").cast("float").alias("value")).toArrow()
    deep, keys, values = (table[name].to_numpy() for name in ("depth", "gram", "value"))
    every = np.arange(65536, dtype=np.int64)
    model = ContextTree(depth, (sum_one_byte(upper, every) / np.log(10)).astype(np.float32), {}, {}, whole)
    for d in range(2, depth + 1):
        mine = (deep == d) & (keys >= 0)
        model.grams[d] = keys[mine], values[mine]
        mine = (deep == d) & (keys < 0)
        model.left[d] = -1 - keys[mine], values[mine]
    return model


_built: dict[str, tuple] = {}


def scorer(name: str, broadcast) -> tuple:
    """The hash tables of a broadcast model, built once in a worker."""
    if name not in _built:
        _built.clear()
        depth, single, grams, left = broadcast.value
        _built[name] = depth, single, {d: Slots(*t) for d, t in grams.items()}, {d: Slots(*t) for d, t in left.items()}
    return _built[name]


def log_probabilities(grams: np.ndarray, tables: tuple) -> np.ndarray:
    """log10 of each position's byte: from the longest context that has met it, less what the longer ones leave over."""
    depth, single, known, left = tables
    value, found = known[depth].find(grams)
    rest = np.flatnonzero(~found)
    for d in range(depth, 1, -1):
        if not len(rest):
            break
        keys = grams[rest] & np.int64((1 << (8 * (d + 1))) - 1)
        value[rest] += left[d].find(keys >> np.int64(8))[0]
        if d == 2:
            value[rest] += single[keys & 0xFFFF]
            break
        more, found = known[d - 1].find(keys & np.int64((1 << (8 * d)) - 1))
        value[rest] += more
        rest = rest[~found]
    return value


def score_texts(texts: pa.Array, tables: tuple, complete: bool = True) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(log10 probability, modelled bytes) of every text, and by block (row, gram, times) of what is not in the tables."""
    score, size, rest = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), []
    for block in text_blocks(texts):
        data, bounds = canonical_bytes(block, find_words(block))
        grams, rows = grams_of(data, bounds, tables[0]), slice(block.first, block.last)
        if complete:
            values = log_probabilities(grams, tables)
        else:
            values, found = tables[2][tables[0]].find(grams)
            at = np.flatnonzero(~found)
            missed, row = grams[at], np.searchsorted(bounds, at, side="right") - 1
            order = np.lexsort((missed, row))
            missed, row = missed[order], row[order]
            new = np.ones(len(missed), dtype=bool)
            new[1:] = (missed[1:] != missed[:-1]) | (row[1:] != row[:-1])
            begins = np.flatnonzero(new)
            rest.append((block.first + row[begins], missed[begins], np.diff(np.append(begins, len(missed))).astype(np.int32)))
        score[rows] = by_row(values.astype(np.float64), bounds)
        size[rows] = np.diff(bounds)
    return score, size, rest


def resolve(asked: DataFrame, model: ContextTree) -> DataFrame:
    """(gram, value): log10 of the byte of each asked gram, from the whole table."""
    sent, depth = asked.sparkSession.sparkContext.broadcast(model.single), model.depth

    def look_up(asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"gram": np.zeros(0, dtype=np.int64), "value": np.zeros(0)})
        deep, keys, values = (table[name].to_numpy() for name in ("depth", "gram", "value"))
        grams, left = {}, {}
        for d in range(2, depth + 1):
            mine = (deep == d) & (keys >= 0)
            grams[d] = Slots(keys[mine], values[mine])
            mine = (deep == d) & (keys < 0)
            left[d] = Slots(-1 - keys[mine], values[mine])
        gram = asks["gram"].to_numpy()
        return pd.DataFrame({"gram": gram, "value": log_probabilities(gram, (depth, sent.value, grams, left)).astype(np.float64)})

    keyed = asked.select("gram").distinct().withColumn("near", F.shiftright("gram", 8).bitwiseAND(0xFFFF))
    return keyed.groupBy("near").cogroup(model.whole.groupBy("near")).applyInPandas(look_up, "gram long, value double")


def known_scores(df: DataFrame, text: str, model: ContextTree) -> DataFrame:
    """``log10_probability``, ``n_bytes``, ``bits_per_byte`` as far as the tasks' table goes, and the grams it lacks.

    Those are lists, ``_missed`` and ``_missed_times``, which ``add_missed`` takes; without them the scores are complete.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.depth, model.single, model.grams, model.left))
    name = uuid.uuid4().hex

    complete = model.whole is None

    def compute(texts: pa.Array) -> list[pa.Array]:
        values, size, rest = score_texts(texts, scorer(name, sent), complete)
        out = [pa.array(values), pa.array(size), pa.array(-values / np.log10(2) / size)]
        if complete:
            return out
        none = np.zeros(0, dtype=np.int64)
        row, gram, times = (np.concatenate([none, *part]) for part in (zip(*rest) if rest else ([none],) * 3))
        bounds = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
        return [*out, pa.ListArray.from_arrays(bounds, pa.array(gram)), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))]

    fields = [T.StructField("log10_probability", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType())]
    if not complete:
        fields += [T.StructField("_missed", T.ArrayType(T.LongType(), False)), T.StructField("_missed_times", T.ArrayType(T.IntegerType(), False))]
    return with_text_columns(df, text, fields, compute)


def add_missed(rows: DataFrame, model: ContextTree) -> DataFrame:
    """Complete the scores of written rows of ``known_scores`` that have a ``_row``, which stays.

    All columns of the rows pass a shuffle, so what is not needed any more, such as the text, should be dropped before.
    """
    if model.whole is None:
        return rows
    missed = rows.select("_row", F.explode(F.arrays_zip("_missed", "_missed_times")).alias("m")).select(
        "_row", F.col("m._missed").alias("gram"), F.col("m._missed_times").alias("times"))
    sums = missed.join(resolve(missed, model), "gram").groupBy("_row").agg(F.sum(F.col("times") * F.col("value")).alias("_more"))
    joined = rows.drop("_missed", "_missed_times").join(sums, "_row", "left")
    total = F.col("log10_probability") + F.coalesce("_more", F.lit(0.0))
    return joined.withColumns({
        "log10_probability": total, "bits_per_byte": -total / float(np.log10(2)) / F.col("n_bytes")}).drop("_more")


def score(df: DataFrame, text: str, model: ContextTree) -> DataFrame:
    """Add ``log10_probability``, ``n_bytes`` and ``bits_per_byte`` of every whole text; columns of these names are replaced.

    A null or empty text is the end alone. A row's score depends on its text alone.
    """
    known = known_scores(df, text, model)
    if model.whole is None:
        return known
    return add_missed(materialize(known.withColumn("_row", F.monotonically_increasing_id())), model).drop("_row")
