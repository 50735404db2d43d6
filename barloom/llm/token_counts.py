"""Counts of greedy word-piece tokens by a linear longest-match automaton (Song et al., Fast WordPiece, 2021).

The vocabulary's pieces form a trie. Each node has a failure link to the node of what remains once the longest pieces
at its start are popped, and the number of those pieces. A word is read once, character by character; following a link
adds its popped pieces to the count, so lengths come without building pieces.

A text's words are its runs without ASCII white space; a word is read with the word mark in front. A character that the vocabulary lacks
ends the match and counts one token for each UTF-8 byte (byte fallback). Defined cases: null and blank texts count 0
words and 0 tokens; repeated rows each keep their row; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barloom.llm import common, words

MARK = "▁"


class PieceCounter:
    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = {p for p in pieces if p}
        if missing := {c for p in pieces for c in p} - pieces:
            raise ValueError(f"characters without a piece of their own: {sorted(missing)[:5]}")
        self.next: list[dict[str, int]] = [{}]
        ends = {0: False}
        for piece in sorted(pieces):
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends[to] = False
                node = to
            ends[node] = True
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if ends[node]:
                    self.popped[node] = 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while c not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                self.fail[node], self.popped[node] = self.next[at][c], popped

    def __call__(self, word: str) -> int:
        """Tokens of the mark and the word."""
        steps, fail, popped = self.next, self.fail, self.popped
        start, count, node = steps[0], 0, 0
        for c in MARK + word:
            to = steps[node].get(c)
            while to is None:
                if not node:
                    count += len(c.encode())
                    break
                count += popped[node]
                node = fail[node]
                to = steps[node].get(c)
            else:
                node = to
        while node:
            count += popped[node]
            node = fail[node]
        return count


def piece_table(model_file: str) -> list[str | None]:
    """Pieces by id of a SentencePiece model, read by the driver; None for control, unknown and byte tokens."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [None if special(i) else m.id_to_piece(i) for i in range(m.get_piece_size())]


_COUNTERS: dict[str, words.Cache] = {}
common.HELD.append(_COUNTERS)


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_tokens, one row a row of docs."""
    pieces = docs.sparkSession.sparkContext.broadcast(piece_table(model_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _COUNTERS:
            one = PieceCounter(p for p in pieces.value if p)
            _COUNTERS[model_file] = words.Cache(lambda new: [one(w) for w in new])
        counter = _COUNTERS[model_file]
        for batch in batches:
            for first, last, part in words.row_slices(batch):
                distinct, codes, begins = words.coded(pc.ascii_split_whitespace(part))
                each = np.array([n if w else 0 for w, n in zip(distinct, counter(distinct), strict=True)], np.int64)
                real = np.array([bool(w) for w in distinct], np.int64)
                tokens, n_words = (words.sums(x[codes], begins) if len(distinct) else np.zeros(len(part), np.int64) for x in (each, real))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n_words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])
        counter.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
