"""Toxicity as the difference of two Kneser-Ney models over the letters of words.

A word is spelled out, with a mark before and after it. Each class has its own counts of a letter after the seven bytes
(or fewer, from the word's beginning) before it; all shorter contexts are shared: continuation counts over both classes,
smoothed down to a uniform byte. An expression that is rare in both classes, or unseen in either, takes its probability
from these shared counts and says little, while variants of a word that only toxic texts use share their beginnings and
need not be seen themselves. The log-likelihood difference, by letter over the whole text, by word over its most striking stretch
and over its most striking words, goes through a logistic calibration fitted on texts left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.blocks import ALPHANUMERIC, Block, Words, by_row, find_words, hash_words, lookup, text_blocks, with_text_columns
from labelsieve.session import materialize

#: Labelled rows of a class that are learnt from, at most.
PER_CLASS = 100_000
ORDER = 7  # bytes of a context; a gram, with its last byte, fills 64 bits
STRETCH = 8
MOST_STRIKING = (1, 4, 8)
FEATURES = 3 + len(MOST_STRIKING)
_BEGIN, _END = 32, 10  # bytes that no word holds
_TEXTS_BYTES = 1 << 20


@dataclass(frozen=True)
class Differences:
    """Log-likelihood differences, toxic less ordinary: of a gram, and of any unseen letter after a context. Keys are sorted."""

    grams: np.ndarray
    gram_values: np.ndarray
    contexts: np.ndarray
    context_values: np.ndarray


@dataclass(frozen=True)
class ToxicityModel:
    """``trend``: what ordinary texts reach in each feature by their number of distinct words, as offset and slope;
    ``weights`` of what lies above it; ``share`` of toxic labels, the score of a text without any word."""

    differences: Differences
    trend: np.ndarray
    weights: np.ndarray
    share: float


def low_bytes(keys: np.ndarray, count: int) -> np.ndarray:
    return keys if count == 8 else keys & np.uint64((1 << 8 * count) - 1)


def distinct_words(block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    """All words of a block, the places of one of each kind, and every word's kind."""
    words = find_words(block, ALPHANUMERIC)
    _, first, kind = np.unique(hash_words(block, words), return_index=True, return_inverse=True)
    return words, first, kind


def spell(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) for every letter of some words and the mark after each: a gram holds the letter in its lowest byte
    and the letters before it in the next ones, the mark before the word among them; what lies further back is zero."""
    sizes = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data = np.append(block.data, np.uint8(0)).astype(np.uint64)
    at = starts[word] + place
    grams = np.where(place < sizes[word] - 1, data[at], np.uint64(_END)) if len(word) else np.zeros(0, dtype=np.uint64)
    for back in range(1, ORDER + 1):
        letter = np.where(place >= back, data[np.maximum(at - back, 0)], np.where(place == back - 1, np.uint64(_BEGIN), np.uint64(0)))
        grams |= letter << np.uint64(8 * back)
    return word, grams


def count_grams(sample: DataFrame, text: str) -> DataFrame:
    """(gram, n0 .. n3): texts of a sample by ``_class`` * 2 + ``_fold`` that hold a word with a gram, summed over words.

    A text counts a word once, so that one text's favourite word is no class's.
    """
    names = ["gram", "n0", "n1", "n2", "n3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.asarray(batch.column(1)) * 2 + np.asarray(batch.column(2))
            for block in text_blocks(batch.column(0), _TEXTS_BYTES, 1 << 20):
                words, first, kind = distinct_words(block)
                kinds = len(first)
                once = np.unique(words.rows * max(kinds, 1) + kind)
                groups = group[block.first:block.last][once // max(kinds, 1)]
                texts = np.bincount(once % max(kinds, 1) * 4 + groups, minlength=kinds * 4).reshape(kinds, 4)
                word, grams = spell(block, words.starts[first], words.ends[first])
                distinct, at = np.unique(grams, return_inverse=True)
                counts = [np.bincount(at, weights=texts[word, k], minlength=len(distinct)).astype(np.int32) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *[pa.array(c) for c in counts]], names=names)

    found = sample.select(text, F.col("_class").cast("int"), F.col("_fold").cast("int")).mapInArrow(run, "gram long, n0 int, n1 int, n2 int, n3 int")
    return found.groupBy("gram").agg(*[F.sum(name).cast("int").alias(name) for name in names[1:]])


def discount(counts: np.ndarray) -> float:
    """The absolute discount estimated from how many counts are one and how many two."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return (ones + 0.5) / (ones + 2 * twos + 1)


def runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ascending array, and which of them each place holds."""
    new = np.ones(len(ascending), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return ascending[new], (np.cumsum(new) - 1).astype(np.int32)


def shared_probability(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams without their furthest letter, sorted, and the probability of their last letter by continuation counts."""
    levels = []
    for size in range(ORDER, 0, -1):  # letters of a gram, itself included
        shorter, extensions = np.unique(low_bytes(grams, size), return_counts=True)
        levels.append((size, shorter, extensions))
        grams = shorter
    below = None
    for size, shorter, extensions in reversed(levels):
        _, context = runs(shorter >> np.uint64(8))
        total, kinds, cut = np.bincount(context, weights=extensions), np.bincount(context), discount(extensions)
        base = np.full(len(shorter), 1 / 256) if below is None else below[1][np.searchsorted(below[0], low_bytes(shorter, size - 1))]
        below = shorter, (np.maximum(extensions - cut, 0) + cut * kinds[context] * base) / total[context]
    return below


def differences(grams: np.ndarray, counts: Sequence[np.ndarray]) -> Differences:
    """The two models' differences from sorted grams and their counts in the ordinary and the toxic class."""
    seen = (counts[0] > 0) | (counts[1] > 0)
    grams, counts = grams[seen], [c[seen] for c in counts]
    if not len(grams):
        nothing = np.zeros(0, dtype=np.uint64)
        return Differences(nothing, np.zeros(0, dtype=np.float32), nothing, np.zeros(0, dtype=np.float32))
    shorter, probability = shared_probability(grams)
    base = probability[np.searchsorted(shorter, low_bytes(grams, ORDER))]
    contexts, context = runs(grams >> np.uint64(8))
    logs, left = [], []
    for own in counts:
        cut, total = discount(own), np.bincount(context, weights=own)
        rest = np.where(total > 0, cut * np.bincount(context, weights=own > 0) / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(own - cut, 0) / np.maximum(total, 1)[context] + rest[context] * base))
        left.append(np.log(rest))
    return Differences(grams, (logs[1] - logs[0]).astype(np.float32), contexts, (left[1] - left[0]).astype(np.float32))


def word_differences(block: Block, starts: np.ndarray, ends: np.ndarray, tables: Differences) -> np.ndarray:
    """Log-likelihood difference of each of some words."""
    word, grams = spell(block, starts, ends)
    at, known = lookup(tables.grams, grams)
    values = np.where(known, tables.gram_values[at] if len(tables.grams) else 0, 0.0)
    unseen = np.flatnonzero(~known)
    at, known = lookup(tables.contexts, grams[unseen] >> np.uint64(8))
    values[unseen] = np.where(known, tables.context_values[at] if len(tables.contexts) else 0, 0.0)
    return np.bincount(word, weights=values, minlength=len(starts))


def text_features(texts: pa.Array, tables: Differences) -> np.ndarray:
    """By text: difference per letter, per word of the most striking stretch, mean of the one, four and eight most striking
    distinct words (fewer, if there are not so many), and the logarithm of the number of distinct words, since the more
    words a text has, the more striking are the most striking ones by chance."""
    out = np.zeros((len(texts), FEATURES))
    for block in text_blocks(texts, _TEXTS_BYTES, 1 << 20):
        words, first, kind = distinct_words(block)
        if not len(kind):
            continue
        by_kind = word_differences(block, words.starts[first], words.ends[first], tables)
        values = by_kind[kind]
        sizes = np.diff(words.bounds)
        letters = by_row(words.ends - words.starts + 1, words.bounds)
        sums = np.concatenate([[0.0], np.cumsum(values)])
        ends = np.arange(1, len(values) + 1)
        begins = np.maximum(ends - STRETCH, np.repeat(words.bounds[:-1], sizes))
        rows = slice(block.first, block.last)
        out[rows, 0] = by_row(values, words.bounds, empty=0.0) / np.maximum(letters, 1)
        out[rows, 1] = by_row((sums[ends] - sums[begins]) / STRETCH, words.bounds, np.maximum, 0.0)
        once = np.unique(words.rows * len(first) + kind)
        row, value = once // len(first), by_kind[once % len(first)]
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for column, most in enumerate(MOST_STRIKING, 2):
            top = place < most
            n = np.bincount(row[top], minlength=len(sizes))
            out[rows, column] = np.bincount(row[top], weights=value[top], minlength=len(sizes)) / np.maximum(n, 1)
        out[rows, FEATURES - 1] = np.log1p(np.bincount(row, minlength=len(sizes)))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method on the small table of calibration features, scaled to unit spread; with one class only, a constant."""
    spread = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    scaling = np.concatenate([[1.0], spread])
    x = np.column_stack([np.ones(len(x)), x / spread])
    share = np.clip(np.average(y, weights=weight) if len(y) else 0.5, 1e-3, 1 - 1e-3)
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return beta / scaling
    weight = weight / weight.sum()
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta / scaling


def fit_trend(x: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """(offset, slope) of every feature but the last over the last one, by least squares over ordinary texts."""
    rows = x[ordinary & (x[:, -1] > 0)]
    if not len(rows):
        return np.zeros((2, x.shape[1] - 1))
    size, values = rows[:, -1], rows[:, :-1]
    spread = size.var()
    slope = ((size - size.mean())[:, None] * values).mean(axis=0) / spread if spread > 1e-9 else np.zeros(values.shape[1])
    return np.stack([values.mean(axis=0) - slope * size.mean(), slope])


def above_trend(x: np.ndarray, trend: np.ndarray) -> np.ndarray:
    return x[:, :-1] - trend[0] - x[:, -1:] * trend[1]


def apply_logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(key, text, _class, _fold) of at most ``per_class`` labelled texts a class, and how many rows each class has."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_class"))
    found = {row._class: row["count"] for row in rows.groupBy("_class").count().collect()}
    order = [F.xxhash64(F.col(key), F.lit("sample")), F.col(key)]
    chosen = [rows.filter(F.col("_class") == c).orderBy(*order).limit(per_class).toArrow() for c in (0, 1)]
    ids = docs.sparkSession.createDataFrame(pa.concat_tables(chosen))
    sample = docs.select(key, text).join(F.broadcast(ids), key)  # two classes of at most per_class ids
    return sample.withColumn("_fold", F.pmod(F.xxhash64(F.col(text), F.lit("fold")), F.lit(2))), found  # copies share a fold


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on labelled texts.

    ``labels`` (key, label 0 or 1) are the rows to learn from; rows without key or label are left out, and the highest
    label of a key counts. At most ``per_class`` rows of each class are used, those whose hashed keys are lowest; this is
    the only bound, all their words count. Equal texts count once. The calibration weighs the rows of a class by the
    class's share of all labels, so a sample that binds for one class does not shift the scores. Without labelled rows
    every score is 0.5; with one class it is near that class.
    """
    sample, found = labelled_sample(docs, labels, key, text, label, per_class)
    distinct = sample.groupBy(F.xxhash64(text), F.md5(text)).agg(*[F.min_by(c, key).alias(c) for c in (text, "_class", "_fold")])
    table = materialize(count_grams(distinct, text)).toArrow()
    order = np.argsort(table["gram"].to_numpy().view(np.uint64)).astype(np.int32)
    grams, counts = table["gram"].to_numpy().view(np.uint64)[order], [table[f"n{k}"].to_numpy()[order] for k in range(4)]
    del table, order  # the driver holds the table once

    def tables(folds: tuple[int, ...]) -> Differences:
        return differences(grams, [sum(counts[c * 2 + f] for f in folds) for c in (0, 1)])

    crossed = docs.sparkSession.sparkContext.broadcast([tables((1,)), tables((0,))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(2))
            features = np.zeros((batch.num_rows, FEATURES))
            for k in (0, 1):
                features[fold == k] = text_features(batch.column(0).filter(pa.array(fold == k)), crossed.value[k])
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in features.T]], names=["c", *names])

    names = [f"x{k}" for k in range(FEATURES)]
    small = sample.select(text, "_class", F.col("_fold").cast("int")).mapInArrow(
        measure, ", ".join(["c int", *[f"{name} double" for name in names]])).toArrow()
    y = small["c"].to_numpy().astype(float)
    x = np.column_stack([small[c].to_numpy() for c in names]) if len(y) else np.zeros((0, FEATURES))
    used = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    weight = np.where(y == 1, found.get(1, 0) / used[1], found.get(0, 0) / used[0])
    share = (found.get(1, 0) + 0.5) / (found.get(0, 0) + found.get(1, 0) + 1)
    trend = fit_trend(x, y == 0)
    return ToxicityModel(tables((0, 1)), trend, fit_logistic(above_trend(x, trend), y, weight) if len(y) else np.zeros(FEATURES), share)


def score(df: DataFrame, text: str, model: ToxicityModel, out: str = "score") -> DataFrame:
    """Add the probability that a whole text is toxic, from 0 to 1; texts without words, null and empty ones among them, get the share of
    toxic labels.

    A row's score depends on its text alone. A column named ``out`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        features = text_features(texts, sent.value.differences)
        found = apply_logistic(above_trend(features, sent.value.trend), sent.value.weights)
        return [pa.array(np.where(features[:, -1] > 0, found, sent.value.share))]

    return with_text_columns(df, text, [T.StructField(out, T.DoubleType())], compute)
