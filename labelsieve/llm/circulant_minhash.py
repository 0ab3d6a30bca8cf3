"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit numbers make a signature of any length: the first spreads the shingles, the second is
shifted circularly by one place for each coordinate. Bands of coordinates give buckets. Texts with equal shingle sets are
one class; in every bucket the classes are first compared with its hub, the class that shares buckets with most others
and so is near the middle of its group, and links and components follow. Then classes that share a bucket but no component
yet are compared among themselves, so that no link between components is lost and a bucket full of copies costs as many
comparisons as it has members. Jaccard distances obey the triangle inequality: two classes whose exact distances to the
hub differ by more than a link allows need no comparison. A link counts after the exact comparison of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.blocks import Block, by_row, find_words, hash_words, mix, text_blocks, with_text_columns
from labelsieve.llm.columns import KEY, with_key
from labelsieve.llm.components import components
from labelsieve.session import materialize


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link needs ``parts`` x intersection >= ``least`` x union.

    A pair at the threshold s shares no band with probability (1 - s^rows)^bands: about 1e-5 for either rule here.
    """

    words: int
    least: int
    parts: int = 100
    rows: int = 6
    bands: int = 24

    def most_differing(self) -> int:
        """Of ``LONG_BITS`` sketched bits, so many differ at most for linked sets: 5.5 standard deviations above the mean."""
        p = (1 - self.least / self.parts) / 2
        return int(LONG_BITS * p + 5.5 * (LONG_BITS * p * (1 - p)) ** 0.5)


CLOSE = Rule(words=3, least=85)
USUAL = Rule(words=5, least=80, rows=5, bands=30)
SKETCH = ["_s1", "_s2"]
UNRELATED_BITS = 48  # of the 128 bits of a short sketch
LONG_BITS = 2048
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def shingle_hashes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, bounds): distinct shingles of every text, sorted; a text of fewer words is one shingle."""
    words = find_words(block)
    hashes = hash_words(block, words)
    counts = np.diff(words.bounds)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        rolled[:max(n - k, 0)] += mix(hashes[k:] * np.uint64(2 * k + 3) + np.uint64(k))
    place = np.arange(n) - words.bounds[:-1][words.rows]
    full = place + size <= counts[words.rows]
    few = np.flatnonzero((counts > 0) & (counts < size))
    short = np.zeros(len(few), dtype=np.uint64)
    for k in range(size - 1):
        has = counts[few] > k
        short[has] += mix(hashes[words.bounds[few[has]] + k] * np.uint64(2 * k + 3) + np.uint64(k + 100))
    values = mix(np.concatenate([rolled[full], short + counts[few].astype(np.uint64)]))
    rows = np.concatenate([words.rows[full], few])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, rows, np.searchsorted(rows, np.arange(len(counts) + 1))


def _permute(x: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=buffer)
        np.bitwise_xor(x, buffer, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=buffer)
    return np.bitwise_xor(x, buffer, out=x)


def signatures(values: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Coordinate k of a set is the least second permutation of its spread shingles, moved k places around the circle."""
    spread = (values >> np.uint64(32)).astype(np.uint32)
    _permute(spread, np.empty_like(spread))
    out = np.zeros((length, len(bounds) - 1), dtype=np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    moved, buffer = np.empty_like(spread), np.empty_like(spread)
    for k in range(length):
        np.add(spread, np.uint32(k), out=moved)  # wraps around at 2^32
        out[k, full] = np.minimum.reduceat(_permute(moved, buffer), bounds[:-1][full])
    return out


def _bits(signature: np.ndarray, first: int) -> np.ndarray:
    packed = np.zeros(signature.shape[1], dtype=np.uint64)
    for k in range(64):
        packed |= ((signature[first + k] >> np.uint32(7)) & np.uint32(1)).astype(np.uint64) << np.uint64(k)
    return packed


def describe(texts: pa.Array, rule: Rule) -> list[pa.Array]:
    """n_shingles, two fingerprints of the set, two words of a sketch of its signature, and its bands."""
    n = len(texts)
    count = np.zeros(n, dtype=np.int64)
    prints = np.zeros((4, n), dtype=np.uint64)
    bands = np.zeros((n, rule.bands), dtype=np.uint64)
    for block in text_blocks(texts):
        values, _, bounds = shingle_hashes(block, rule.words)
        rows = slice(block.first, block.last)
        count[rows] = np.diff(bounds)
        prints[0, rows] = by_row(mix(values * np.uint64(3)), bounds)
        prints[1, rows] = by_row(mix(values ^ _SPREAD), bounds)
        signature = signatures(values, bounds, max(rule.rows * rule.bands, 128))
        for k in range(2):
            prints[2 + k, rows] = _bits(signature, 64 * k)
        for band in range(rule.bands):
            joined = np.full(block.last - block.first, band, dtype=np.uint64)
            for k in range(band * rule.rows, (band + 1) * rule.rows):
                joined = mix(joined * np.uint64(31) + signature[k])
            bands[rows, band] = joined
    flat = pa.array(bands.reshape(-1).view(np.int64))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(rule.bands)), flat)
    return [pa.array(count), *[pa.array(p.view(np.int64)) for p in prints], lists]


def sets_of(texts: pa.Array, rule: Rule) -> list[pa.Array]:
    parts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for block in text_blocks(texts):
        values, _, bounds = shingle_hashes(block, rule.words)
        parts.append(values.view(np.int64))
        ends.append(bounds[1:] + ends[-1][-1])
    return [pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(parts)))]


def is_link(rule: Rule, common: Column, a: Column, b: Column) -> Column:
    return rule.parts * common >= rule.least * (a + b - common)


def near_sizes(rule: Rule, a: Column, b: Column) -> Column:
    """Whether two sets of these sizes can be linked at all."""
    return rule.parts * F.least(a, b) >= rule.least * F.greatest(a, b)


def long_sketches(texts: pa.Array, rule: Rule) -> list[pa.Array]:
    """``LONG_BITS`` bits of each set: the lowest bit of as many further coordinates of its signature."""
    bits = np.zeros((len(texts), LONG_BITS // 64), dtype=np.uint64)
    for block in text_blocks(texts):
        values, _, bounds = shingle_hashes(block, rule.words)
        signature = signatures(values, bounds, LONG_BITS)
        for k in range(LONG_BITS // 64):
            bits[block.first:block.last, k] = _bits(signature, 64 * k)
    return [pa.array(column.view(np.int64)) for column in np.ascontiguousarray(bits.T)]


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(cls, text) of some classes."""
    keys = classes.join(wanted, "cls").select("cls", *KEY)
    return docs.select(*KEY, text).join(keys, KEY).dropDuplicates(["cls"]).select("cls", text)


def differing(a: str, b: str) -> Column:
    """Bits in which the short sketches of two rows differ; ``a`` and ``b`` are prefixes of the columns."""
    return sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH), F.lit(0))


def compare_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    """(a, b, linked, distance) of pairs of classes, from their whole sets."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    held = texts_of(ends, classes, docs, text)
    fields = [T.StructField("shingles", T.ArrayType(T.LongType(), False))]
    sets = materialize(with_text_columns(held, text, fields, lambda texts: sets_of(texts, rule)).drop(text))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("_a")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("shingles").alias("_b")), "b")
    counted = both.select("a", "b", F.size("_a").alias("na"), F.size("_b").alias("nb"), F.size(F.array_intersect("_a", "_b")).alias("c"))
    union = F.col("na") + F.col("nb") - F.col("c")
    return counted.select("a", "b", is_link(rule, F.col("c"), F.col("na"), F.col("nb")).alias("linked"), (1 - F.col("c") / union).alias("distance"))


def near_duplicates(docs: DataFrame, text: str, doc_id: str, rule: Rule = CLOSE) -> DataFrame:
    """``docs`` without the text, with ``n_shingles``, ``component_id`` and ``kept``, one row for each row.

    ``component_id`` is the smallest id reachable over links; rows of one id are linked by it. Texts without words are
    linked with nothing. A row without id takes part in no link: its component is null and it is kept. Columns of these
    names are replaced. Shingles are compared by 64-bit hashes.
    """
    new = ["n_shingles", "component_id", "kept"]
    rows = with_key(docs.drop(*[c for c in new if c not in (text, doc_id)]), doc_id, text)
    fields = [T.StructField(name, T.LongType()) for name in ("n_shingles", "_p1", "_p2", *SKETCH)]
    fields.append(T.StructField("_bands", T.ArrayType(T.LongType(), False)))
    known = materialize(with_text_columns(rows, text, fields, lambda texts: describe(texts, rule)).drop(text))

    filled = known.filter(F.col(doc_id).isNotNull() & (F.col("n_shingles") > 0))
    prints = ["_p1", "_p2", "n_shingles"]
    classes = materialize(
        filled.groupBy(*prints).agg(
            F.min(F.struct(F.col(doc_id).alias("id"), *KEY, *SKETCH, "_bands")).alias("m"))
        .select(
            *prints, F.xxhash64(*prints).alias("cls"), F.col("m.id").alias("id"), *[F.col(f"m.{k}").alias(k) for k in KEY],
            *[f"m.{c}" for c in SKETCH], "m._bands"))
    members = classes.select("cls", F.col("n_shingles").alias("n"), *SKETCH, F.posexplode("_bands").alias("band", "bucket"))
    place = ["band", "bucket"]
    shared = materialize(members.groupBy(*place).agg(F.count("*").alias("size")).filter("size > 1"))
    crowded = materialize(members.join(shared, place))
    central = materialize(crowded.groupBy("cls").agg(F.sum("size").alias("central")))
    crowded = materialize(crowded.drop("size").join(central, "cls"))
    hubs = materialize(crowded.groupBy(*place).agg(F.max(F.struct("central", "cls", "n", *SKETCH)).alias("h")).select(
        *place, F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), *[F.col(f"h.{c}").alias(f"hub{c}") for c in SKETCH]))
    crowded = materialize(crowded.drop("central").join(hubs, place).withColumn("near_hub", near_sizes(rule, F.col("n"), F.col("hub_n")) & (
        differing("", "hub") <= UNRELATED_BITS)).drop("hub_n", *[f"hub{c}" for c in SKETCH]))
    whole = rows.select(*KEY, text)

    first = materialize(crowded.filter("near_hub AND cls <> hub").select(
        F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())
    compared = materialize(compare_sets(first, classes, whole, text, rule))
    links = compared.filter("linked").select("a", "b")
    parts = materialize(components(links))

    far = compared.select(F.col("a").alias("cls"), F.col("b").alias("hub"), "distance").unionByName(
        compared.select(F.col("b").alias("cls"), F.col("a").alias("hub"), "distance"))
    placed = crowded.drop("near_hub").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    placed = materialize(placed)
    sizes = placed.groupBy(*place, "component").agg(F.count("*").alias("members"))
    biggest = sizes.groupBy(*place).agg(
        F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    biggest = materialize(biggest.select(*place, F.col("top.component").alias("top")))
    mixed = materialize(placed.join(biggest, place))
    mixed = materialize(mixed.join(materialize(far), ["cls", "hub"], "left").withColumn(
        "distance", F.when(F.col("cls") == F.col("hub"), 0.0).otherwise(F.col("distance"))))
    names = [f"_l{k}" for k in range(LONG_BITS // 64)]
    fields = [T.StructField(name, T.LongType()) for name in names]
    sketches = texts_of(mixed.select("cls").distinct(), classes, whole, text)
    sketches = materialize(with_text_columns(sketches, text, fields, lambda texts: long_sketches(texts, rule)).drop(text))
    mixed = materialize(mixed.drop(*SKETCH).join(sketches, "cls").join(classes.select("cls", "_bands"), "cls"))
    earlier = F.exists(F.zip_with(  # a pair is compared in the first bucket that it shares
        F.slice("a._bands", F.lit(1), F.col("a.band")), F.slice("b._bands", F.lit(1), F.col("a.band")), lambda x, y: x == y), lambda e: e)
    unlike = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in names), F.lit(0))
    minor, others = mixed.filter("component <> top").alias("a"), mixed.alias("b")
    apart = F.abs(F.col("a.distance") - F.col("b.distance")) > 1 - rule.least / rule.parts + 1e-9
    rest = minor.join(others, [
        F.col("a.band") == F.col("b.band"), F.col("a.bucket") == F.col("b.bucket"), F.col("a.component") != F.col("b.component"),
        near_sizes(rule, F.col("a.n"), F.col("b.n")), unlike <= rule.most_differing(), ~F.coalesce(apart, F.lit(False)),
        (F.col("b.component") == F.col("b.top")) | (F.col("a.cls") < F.col("b.cls")), ~earlier])
    rest = materialize(rest.select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct())
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(compare_sets(rest, classes, whole, text, rule).filter("linked").select("a", "b"))

    ids = classes.select("cls", "id")
    of_class = links.join(ids.select(F.col("cls").alias("a"), F.col("id").alias("ia")), "a").join(
        ids.select(F.col("cls").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    own = filled.join(classes.select(*prints, "id"), prints).select(F.col(doc_id).alias("a"), F.col("id").alias("b"))
    reached = components(of_class.unionByName(own))
    out = known.drop("_bands", "_p1", "_p2", *SKETCH, *KEY).join(reached, F.col(doc_id) == F.col("node"), "left")
    component = F.coalesce("component", F.col(doc_id))
    return out.withColumn("component_id", component).withColumn(
        "kept", F.coalesce(F.col(doc_id) == component, F.lit(True))).drop("node", "component")


def keep_one(docs: DataFrame, text: str, doc_id: str, rule: Rule = USUAL) -> DataFrame:
    """One row of every group of near-duplicates, the one of the smallest id; of rows that repeat an id, one."""
    keep = near_duplicates(docs.select(doc_id, text), text, doc_id, rule).filter("kept").select(doc_id)
    first = docs.filter(F.col(doc_id).isNotNull()).join(keep.distinct(), doc_id, "left_semi").dropDuplicates([doc_id])
    return first.select(docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
