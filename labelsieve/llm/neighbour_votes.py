"""Text quality by the votes of labelled neighbours in a latent semantic space.

A text's terms are its byte trigrams and, for every word, its shape and whether it only repeats a word before it; they are
counted in a fixed number of hashed dimensions, weighted by inverse document frequencies over all texts, and projected on
the leading singular vectors of a bounded sample of labelled texts. The sample's vectors go to every task; the cosines of
a block of texts with all of them are one matrix product, and the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.blocks import Block, find_words, hash_words, mix, text_blocks, with_text_columns

SAMPLE_ROWS = 4_000
DIMENSIONS = 2_048
RANK = 64
NEIGHBOURS = 7
_SHAPE_SALT, _REPEAT_SALT = np.uint64(1 << 40), np.uint64(2 << 40)
_ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class VoteModel:
    """``weights``: inverse document frequencies; ``axes``: dimensions x rank; unit ``vectors`` of labelled texts, their
    labels, and the share of label 1, which is the score of a text without any similar neighbour."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def _dimension(codes: np.ndarray) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64)


def _word_terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, dimension) of every word's shape and of every word that the text has had before."""
    words = find_words(block)
    if not len(words.starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data, rows = block.data, words.rows
    big = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122) | (data >= 128))])
    upper, lower = (sums[words.ends] - sums[words.starts] for sums in (big, small))
    sizes = words.ends - words.starts
    first, last = data[words.starts], data[words.ends - 1]
    kind = np.select([(lower == 0) & (upper == 0), (lower == 0) & (upper > 1), (first >= 65) & (first <= 90)], [0, 1, 2], 3)
    last = last.astype(np.int64)
    end = np.select([(last >= 48) & (last <= 57), (last >= 65) & (last <= 90) | (last >= 97) & (last <= 122) | (last >= 128)], [0, 1], 2 + last)
    length = np.minimum(np.log2(sizes).astype(np.int64), 6)
    shapes = (kind * 300 + end) * 8 + length
    hashes = hash_words(block, words)
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    beside = np.zeros(len(hashes), dtype=bool)
    beside[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    repeats = np.flatnonzero(again)
    long = np.minimum(length[repeats], 3) * 2 + beside[repeats]
    return np.concatenate([rows, rows[repeats]]), np.concatenate([
        _dimension(shapes.astype(np.uint64) + _SHAPE_SALT), _dimension(long.astype(np.uint64) + _REPEAT_SALT)])


def term_counts(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """By block of texts: which texts, and their term counts (texts x dimensions)."""
    for block in text_blocks(texts, max_rows=_ROWS_AT_ONCE, lower=False):
        n, data = block.last - block.first, block.data
        rows = np.repeat(np.arange(n), np.diff(block.offsets))
        codes = np.zeros(0, dtype=np.uint64)
        inside = np.zeros(0, dtype=bool)
        if len(data) > 2:
            wide = data.astype(np.uint64)
            codes = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
            inside = rows[:-2] == rows[2:]
        counts = np.bincount(rows[:-2][inside] * DIMENSIONS + _dimension(codes[inside]), minlength=n * DIMENSIONS) if len(codes) else np.zeros(
            n * DIMENSIONS, dtype=np.int64)
        word_rows, dimensions = _word_terms(block)
        counts = counts + np.bincount(word_rows * DIMENSIONS + dimensions, minlength=n * DIMENSIONS)
        yield slice(block.first, block.last), counts.reshape(n, DIMENSIONS)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * weights)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of texts with a term, by dimension, and the number of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, counts in term_counts(batch.column(0)):
                held += (counts > 0).sum(axis=0)
        dims = np.arange(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(np.concatenate([[total], held]))], names=["dim", "n"])

    found = df.select(text).mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    out[found["dim"].to_numpy() + 1] = found["n"].to_numpy()
    return out[1:], int(out[0])


def leading_axes(matrix: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors (columns) by subspace iteration from a fixed start."""
    rank = min(rank, *matrix.shape)
    if rank == 0:
        return np.zeros((matrix.shape[1], 0))
    start = np.random.default_rng(13).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape)))
    for _ in range(rounds):
        start, _ = np.linalg.qr(matrix.T @ (matrix @ start))
    _, _, turned = np.linalg.svd(matrix @ start, full_matrices=False)
    return (start @ turned.T)[:, :rank]


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled texts, those whose hashed keys are lowest: (text, label)."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_class"))
    chosen = rows.orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(most)
    ids = docs.sparkSession.createDataFrame(chosen.toArrow(), chosen.schema)
    return docs.select(key, text).join(F.broadcast(ids), key).groupBy(key).agg(  # at most ``most`` ids
        F.min(text).alias(text), F.first("_class").alias("_class"))


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS, rank: int = RANK,
) -> VoteModel:
    """Document frequencies of all ``docs``, axes and voters from at most ``sample_rows`` labelled ones.

    ``labels`` (key, label 0 or 1) are the rows to learn from; rows without key or label, or whose key has no document,
    are left out; the highest label and the least text of a repeated key count. Without labelled rows there are no voters.
    """
    found, total = document_frequencies(docs, text)
    weights = np.log((1 + total) / (1 + found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, counts in term_counts(batch.column(0)):
                values = weighted(counts, weights).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * DIMENSIONS), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1)[rows.start:rows.stop], batch.column(2)[rows.start:rows.stop], lists], names=["_key", "c", "v"])

    sample = labelled_sample(docs, labels, key, text, label, sample_rows)
    voters = sample.select(text, F.col("_class"), F.xxhash64(key).alias("_key")).select(text, "_key", "_class")
    table = voters.mapInArrow(run, "_key long, c int, v array<float>").toArrow().sort_by("_key")
    classes = table["c"].to_numpy().astype(float)
    matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(len(classes), DIMENSIONS) if len(classes) else np.zeros((0, DIMENSIONS), dtype=np.float32)
    axes = leading_axes(matrix, rank).astype(np.float32)
    share = (classes.sum() + 0.5) / (len(classes) + 1)
    return VoteModel(weights, axes, unit_rows(matrix @ axes), classes, float(share))


def votes(texts: pa.Array, model: VoteModel, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest voters, by text.

    Similarities are compared at five decimals, and all voters as near as the last one vote, so that neither the order
    of the voters nor the block that a text comes in matters.
    """
    out = np.full(len(texts), model.share)
    k = min(neighbours, len(model.labels))
    if k == 0 or model.axes.shape[1] == 0:
        return out
    for rows, counts in term_counts(texts):
        vectors = unit_rows(weighted(counts, model.weights).astype(np.float32) @ model.axes)
        near = np.round(vectors @ model.vectors.T, 5)
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= np.maximum(last, 1e-5)[:, None], near, 0).astype(np.float64)
        total = weight.sum(axis=1)
        prior = 1e-3
        out[rows] = (weight @ model.labels + prior * model.share) / (total + prior)
    return out


def score(df: DataFrame, text: str, model: VoteModel, out: str = "score", neighbours: int = NEIGHBOURS) -> DataFrame:
    """Add the votes' share for label 1, from 0 to 1, of every whole text.

    A null or empty text, or one without a similar neighbour, gets the share of label 1 among the voters. A row's score
    depends on its text alone; repeated rows stay. A column named ``out`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.clip(votes(texts, sent.value, neighbours), 0.0, 1.0))]

    return with_text_columns(df, text, [T.StructField(out, T.DoubleType())], compute)
