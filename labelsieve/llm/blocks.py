"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A batch is cut into blocks of whole texts of about a megabyte, so the arrays stay in the processor's cache and a task's
memory does not depend on the batch. One text longer than that is a block of its own: memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and everything beyond ASCII, for words without the punctuation around them.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


class Block(NamedTuple):
    """Texts ``first`` .. ``last`` (exclusive) of a batch: lower-cased bytes, and where each text begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """``starts``, ``ends``: byte positions in the block; ``rows``: the text a word is in; ``bounds``: words by text."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray


def text_blocks(
    texts: pa.Array, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS, lower: bool = True,
) -> Iterator[Block]:
    """Blocks of whole texts, with A-Z in lower case unless ``lower`` is off; a null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    content = texts.buffers()[2]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + max_rows, len(texts))
        part = data[offsets[first]:offsets[last]]
        part = _LOWER[part] if lower else part
        yield Block(first, last, part, offsets[first:last + 1] - offsets[first])
        first = last


def find_words(block: Block, inside: np.ndarray = _WORD) -> Words:
    """Maximal runs of bytes of a kind, by default all but white space; a word never spans two texts."""
    n, data, offsets = block.last - block.first, block.data, block.offsets
    inside = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    before[offsets[:-1]] = False
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, rows, np.searchsorted(rows, np.arange(n + 1)))


def _power(kind: str, base: int, length: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < length:
        steps = np.full(max(length, 2 * BLOCK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:length]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def hash_words(block: Block, words: Words) -> np.ndarray:
    """64-bit hashes of the words: differences of one running polynomial over the block's bytes."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    length = len(block.data)
    running = np.zeros(length + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[block.data] * _power("up", _MULTIPLIER, length), out=running[1:])
    hashes = (running[words.ends] - running[words.starts]) * _power("down", _INVERSE, length + 1)[words.starts]
    return mix(hashes + (words.ends - words.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def by_row(values: np.ndarray, bounds: np.ndarray, how: np.ufunc = np.add, empty=0) -> np.ndarray:
    """``how`` over the values of every text; ``empty`` for a text without values."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = how.reduceat(values, bounds[:-1][full])
    return out


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def with_text_columns(
    df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]],
) -> DataFrame:
    """Add columns that ``compute`` derives from a batch of texts. Columns of the same names are replaced."""
    new = {field.name for field in fields}
    rest = df.drop(*[name for name in df.columns if name in new and name != text])
    schema = T.StructType([field for field in rest.schema.fields if field.name not in new] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [column for name, column in zip(batch.schema.names, batch.columns) if name not in new]
            texts = batch.column(batch.schema.get_field_index(text))
            yield pa.RecordBatch.from_arrays([*kept, *compute(texts)], names=schema.names)

    return rest.mapInArrow(run, schema)
