"""Word-piece lengths by a linear longest-match automaton.

Greedy longest-match tokenization without restarts: the vocabulary is a trie; where a word leaves the trie, the failure
link of its node says where to go on, and the node knows how many pieces are then complete. So every byte of a word is
looked at once and no piece is built. All words of a block run through the automaton side by side, distinct words once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelsieve.llm.blocks import by_row, find_words, hash_words, text_blocks, with_text_columns

BLOCK = 4 << 20


class Automaton:
    """Trie of the pieces with failure links and popped-token counts; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        pieces = [piece for piece in pieces if piece]
        children: dict[tuple[int, int], int] = {}
        parents, letters, depth, final = [0], [0], [0], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if (node, byte) not in children:
                    children[node, byte] = len(parents)
                    parents.append(node)
                    letters.append(byte)
                    depth.append(depth[node] + 1)
                    final.append(False)
                node = children[node, byte]
            final[node] = True
        if sum((0, byte) in children and final[children[0, byte]] for byte in range(256)) < 256:
            raise ValueError("every single byte must be a piece")
        failure, popped = [0] * len(parents), [0] * len(parents)
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            if final[node]:
                failure[node], popped[node] = 0, 1
                continue
            at, count = failure[parents[node]], popped[parents[node]]
            while (at, letters[node]) not in children:  # ends at the root, which has every byte
                count += popped[at]
                at = failure[at]
            failure[node], popped[node] = children[at, letters[node]], count
        keys = np.array([node * 256 + byte for node, byte in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(children.values(), dtype=np.int64, count=len(keys))[order]
        self.failure, self.popped = np.array(failure, dtype=np.int64), np.array(popped, dtype=np.int64)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
        """Number of pieces of each word, with the byte ``first`` put before it."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that the words still running are in front
        starts, sizes = starts[order], (ends - starts)[order]
        node, count = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        steps = int(sizes[0]) + 1 if len(sizes) else 0
        running = len(order) - np.searchsorted(np.sort(sizes), np.arange(steps), side="left")
        for step in range(steps):
            live = np.arange(running[step]) if step else np.arange(len(order))
            byte = data[starts[live] + step - 1].astype(np.int64) if step else np.full(len(live), first, dtype=np.int64)
            self._advance(node, count, live, byte)
        live = np.flatnonzero(node)
        while len(live):
            count[live] += self.popped[node[live]]
            node[live] = self.failure[node[live]]
            live = live[node[live] > 0]
        out = np.empty_like(count)
        out[order] = count
        return out

    def _advance(self, node: np.ndarray, count: np.ndarray, live: np.ndarray, byte: np.ndarray) -> None:
        while len(live):
            keys = node[live] * 256 + byte
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            node[live[found]] = self.nodes[at[found]]
            live, byte = live[~found], byte[~found]
            count[live] += self.popped[node[live]]
            node[live] = self.failure[node[live]]



def piece_counts(texts: pa.Array, automaton: Automaton) -> list[pa.Array]:
    n_words, n_pieces = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for block in text_blocks(texts, BLOCK, lower=False):
        words = find_words(block)
        _, first, at = np.unique(hash_words(block, words), return_index=True, return_inverse=True)
        lengths = automaton.lengths(block.data, words.starts[first], words.ends[first], 32)
        rows = slice(block.first, block.last)
        n_words[rows] = np.diff(words.bounds)
        n_pieces[rows] = by_row(lengths[at], words.bounds)
    return [pa.array(n_words), pa.array(n_pieces)]


def count_pieces(df: DataFrame, text: str, pieces: list[bytes]) -> DataFrame:
    """Add ``n_words`` and ``n_pieces`` of every whole text.

    A word is a run without white space; it is cut, with one space put before it, into the longest pieces of the
    vocabulary from left to right. Null and empty texts have no words. Columns of these names are replaced. The vocabulary,
    whose size its file fixes, must hold every single byte.
    """
    automaton = Automaton(pieces)
    arrays = df.sparkSession.sparkContext.broadcast((automaton.keys, automaton.nodes, automaton.failure, automaton.popped))

    def compute(texts: pa.Array) -> list[pa.Array]:
        here = Automaton.__new__(Automaton)
        here.keys, here.nodes, here.failure, here.popped = arrays.value
        return piece_counts(texts, here)

    return with_text_columns(df, text, [T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())], compute)
