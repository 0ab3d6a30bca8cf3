"""BPE encoding and decoding over tables of distinct words.

Spark splits the texts into words with the tokenizer's own pattern. In every partition the words' distinct values form a
table; a distinct word is encoded once for it, and the ids are joined back by position. Decoding joins every id with
its piece of the vocabulary, whose size is fixed by the tokenizer file, and concatenates the pieces.

The distinct-word table is kept by partition: one for the whole corpus would send every word occurrence through a
shuffle twice, several times the size of the input, to save a few microseconds for a word.
"""

from __future__ import annotations

import json
from itertools import chain
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken import Encoding
from tokenizers import Tokenizer

#: Fixed value: the word pattern of byte-level BPE. White space is that of Unicode.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 200_000


def read_tokenizer(path: str) -> str:
    """The tokenizer's definition, to be sent to the tasks; truncation and padding are left out."""
    with open(path, encoding="utf-8") as file:
        tokenizer = Tokenizer.from_str(file.read())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer.to_str()


def added_tokens(definition: str) -> list[str]:
    return [token["content"] for token in json.loads(definition)["added_tokens"]]


def is_whole(text: Column, added: list[str]) -> Column:
    """Whether a text holds an added token, or a character that this Java does not know: the tokenizer splits it itself."""
    unknown = (F.octet_length(text) > F.length(text)) & text.rlike(r"\p{Cn}")
    for token in added:
        unknown = unknown | text.contains(token)
    return F.coalesce(unknown, F.lit(False))


def split_words(text: Column, whole: Column) -> Column:
    """Words of a text in order; a whole text is one word."""
    split = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    return F.coalesce(F.when(whole, F.array(text)).otherwise(split), F.array().cast("array<string>"))


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + n): byte for n, byte in enumerate(others)}


def word_encoder(definition: str) -> Encoding:
    """An encoder of single words with the file's vocabulary, in which ids are in the order of merges."""
    model, to_byte = json.loads(definition)["model"], printable_bytes()
    ranks = {bytes(to_byte[c] for c in piece): at for piece, at in model["vocab"].items() if all(c in to_byte for c in piece)}
    merged = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    return Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class WordTable:
    """Distinct words met by this worker, each with its ids in one flat array; words beyond its capacity are kept for
    one slice of a batch."""

    def __init__(self, definition: str):
        self.words = word_encoder(definition)
        self.definition = definition
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def encode(self, words: list[str], whole: set[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [self.words.encode_ordinary(w) if w not in whole else [] for w in words]
        if whole:  # rare, so the library's tokenizer is not kept
            texts = Tokenizer.from_str(self.definition)
            encoded = [texts.encode(w, add_special_tokens=False).ids if w in whole else e for w, e in zip(words, encoded)]
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return sizes, np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(sizes.sum()))

    def find(self, words: list[str], whole: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, start of every word's ids, their number) for distinct words."""
        new = [word for word in words if word not in self.place]
        sizes, ids = self.encode(new, whole)
        starts, flat = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)]), np.concatenate([self.ids, ids])
        here = dict(zip(new, range(len(self.place), len(self.place) + len(new))))
        place = np.fromiter((here[w] if w in here else self.place[w] for w in words), dtype=np.int64, count=len(words))
        if not whole and len(self.place) + len(new) <= CACHED_WORDS:
            self.place.update(here)
            self.starts, self.ids = starts, flat
        return flat, starts[place], starts[place + 1] - starts[place]


_tables: dict[str, WordTable] = {}


def word_table(definition: str) -> WordTable:
    """The table of this worker for a tokenizer: it outlives a task."""
    if definition not in _tables:
        _tables.clear()
        _tables[definition] = WordTable(definition)
    return _tables[definition]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + size]``, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[np.arange(len(shift)) + shift]


def ids_of(table: WordTable, words: pa.ListArray, whole: np.ndarray) -> pa.ListArray:
    """Ids of every list of words, joined back by position. ``whole`` marks lists whose one word is a whole text."""
    bounds = np.asarray(words.offsets)
    distinct = words.values[int(bounds[0]):int(bounds[-1])].dictionary_encode()
    if not len(distinct):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(words) + 1, dtype=np.int32)), pa.array([], pa.int32()))
    texts = {words[int(row)].as_py()[0] for row in np.flatnonzero(whole)}
    flat, starts, sizes = table.find(distinct.dictionary.to_pylist(), texts)
    at = np.asarray(distinct.indices)
    starts, sizes = starts[at], sizes[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gather(flat, starts, sizes)))


def slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def encode(df: DataFrame, text: str, definition: str, out: str = "ids") -> DataFrame:
    """Add the ids of every whole text as ``out``; a null text has the ids of an empty one, none.

    Every row is encoded by itself, so repeated rows, ties and clashing names of other columns do not matter; a column
    named ``out`` is replaced.
    """
    rest = df.drop(out)
    whole = is_whole(F.col(text), added_tokens(definition))
    words = split_words(F.col(text), whole)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(definition)
        for received in batches:
            for batch in slices(received):
                marks = np.asarray(batch.column(-1).to_numpy(zero_copy_only=False), dtype=bool)
                ids = ids_of(table, batch.column(batch.num_columns - 2), marks)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ids], names=schema.names)

    return rest.select("*", words.alias("_words_"), whole.alias("_whole_")).mapInArrow(run, schema)


def vocabulary(definition: str) -> pa.BinaryArray:
    """The id-to-piece table: bytes of every id, in the order of ids."""
    to_byte, parsed = printable_bytes(), json.loads(definition)
    known = {at: bytes(to_byte[c] for c in piece) for piece, at in parsed["model"]["vocab"].items()}
    known |= {token["id"]: token["content"].encode() for token in parsed["added_tokens"]}
    pieces = [known.get(at, b"") for at in range(max(known) + 1)]
    return pa.array(pieces, pa.binary())


def decode(df: DataFrame, ids: str, definition: str, out: str = "decoded") -> DataFrame:
    """Add the text of the ids as ``out``; null ids, and ids outside the vocabulary, give no text.

    Bytes that are not UTF-8 are replaced as the tokenizer does. A column named ``out`` is replaced.
    """
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])
    at = rest.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(definition)
        none = pa.scalar(None, pa.int32())
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column(at)
                bounds = np.asarray(lists.offsets)
                wanted = lists.values[int(bounds[0]):int(bounds[-1])]
                wanted = pa.compute.if_else(
                    pa.compute.and_(pa.compute.greater_equal(wanted, 0), pa.compute.less(wanted, len(table))), wanted, none)
                pieces = pa.compute.fill_null(table.take(wanted), b"")  # the join of ids and pieces
                if isinstance(pieces, pa.ChunkedArray):
                    pieces = pieces.combine_chunks()
                cuts = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
                content = memoryview(pieces.buffers()[2] or b"")
                ends = cuts[bounds - bounds[0]]
                texts = [str(content[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)
