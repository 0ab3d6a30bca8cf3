"""Add-one word probabilities of texts against the word counts of a training part.

Counts of the most frequent words, a fixed number of them, go to every task; the other words of a text meet their counts
in a join on the word's hash, so no count of any word is left out and no table that grows with the corpus is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.blocks import by_row, find_words, hash_words, lookup, text_blocks, with_text_columns
from labelsieve.session import materialize

FREQUENT = 131_072


@dataclass
class WordCounts:
    """``table`` (word, c) by 64-bit hash; ``ends`` texts, ``tokens`` words and ends, ``types`` distinct ones."""

    table: DataFrame
    ends: int
    tokens: int
    types: int


def count_words(texts: DataFrame, text: str) -> WordCounts:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0), 8 << 20, 1 << 20):
                hashes, counts = np.unique(hash_words(block, find_words(block)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["word", "c"])

    counts = texts.select(text).mapInArrow(run, "word long, c long")
    counts = materialize(counts.groupBy("word").agg(F.sum("c").alias("c")))
    ends = texts.count()
    total = counts.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    return WordCounts(counts, ends, (total.c or 0) + ends, total.n + (1 if ends else 0))


def known_words(df: DataFrame, text: str, counts: WordCounts, frequent: int = FREQUENT) -> DataFrame:
    """``n_tokens``, ``n_known`` and ``base_score`` as far as frequent words go, and a text's other words.

    Those are lists, ``_rare`` and ``_rare_times``, which ``add_rare`` takes.
    """
    top = counts.table.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    words = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    sent = df.sparkSession.sparkContext.broadcast((words[order], np.log10(top["c"].to_numpy()[order] + 1.0)))

    def compute(texts: pa.Array) -> list[pa.Array]:
        keys, logs = sent.value
        n = len(texts)
        tokens, known, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
        rare, sizes, ends = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], np.zeros(n + 1, dtype=np.int64)
        for block in text_blocks(texts):
            found_words = find_words(block)
            hashes = hash_words(block, found_words)
            at, found = lookup(keys, hashes)
            rows = slice(block.first, block.last)
            tokens[rows] = np.diff(found_words.bounds)
            known[rows] = by_row(found.astype(np.int64), found_words.bounds)
            base[rows] = by_row(np.where(found, logs[at] if len(logs) else 0, 0.0), found_words.bounds)
            left = np.flatnonzero(~found)
            left = left[np.lexsort((hashes[left], found_words.rows[left]))]
            word, row = hashes[left], found_words.rows[left]
            new = np.ones(len(left), dtype=bool)
            new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
            begins = np.flatnonzero(new)
            rare.append(word[begins])
            sizes.append(np.diff(np.append(begins, len(left))).astype(np.int32))
            ends[block.first + 1:block.last + 1] = np.bincount(row[begins], minlength=block.last - block.first)
        bounds = pa.array(np.cumsum(ends).astype(np.int32))
        return [
            pa.array(tokens), pa.array(known), pa.array(base),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rare).view(np.int64))),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sizes)))]

    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("_rare", T.ArrayType(T.LongType(), False)), T.StructField("_rare_times", T.ArrayType(T.IntegerType(), False))]
    return with_text_columns(df, text, fields, compute)


def add_rare(rows: DataFrame, counts: WordCounts) -> DataFrame:
    """Complete the scores of written rows of ``known_words`` that have a ``_row``, which stays."""
    rare = rows.select("_row", F.explode(F.arrays_zip("_rare", "_rare_times")).alias("w")).select(
        "_row", F.col("w._rare").alias("word"), F.col("w._rare_times").alias("times"))
    sums = rare.join(counts.table, "word").groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_base"))
    joined = rows.drop("_rare", "_rare_times").join(sums, "_row", "left")
    tokens, size = F.col("n_tokens") + 1, float(counts.tokens + counts.types + 1)
    end = float(np.log10(counts.ends + 1))
    return joined.withColumns({
        "n_tokens": tokens, "n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)) + (1 if counts.ends else 0),
        "base_score": F.col("base_score") + F.coalesce("_base", F.lit(0.0)) + end - tokens * float(np.log10(size))}).drop("_known", "_base")


def base_scores(df: DataFrame, text: str, counts: WordCounts, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_tokens``, ``n_known`` and ``base_score`` of whole texts; columns of these names are replaced.

    The tokens of a text are its words and one end; a token seen c times in training has the probability
    (c + 1) / (tokens + types + 1). Null and empty texts have the end alone. Every row is scored by itself.
    """
    known = known_words(df, text, counts, frequent).drop(text)
    return add_rare(materialize(known.withColumn("_row", F.monotonically_increasing_id())), counts).drop("_row")
