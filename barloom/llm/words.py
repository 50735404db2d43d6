"""Unique words of text batches, so that costly per-word work is done once a distinct word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_ROWS = 2_000
SLICE_BYTES = 8 << 20


def row_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, texts) with null as the empty text, of about most_bytes each."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = min(first + SLICE_ROWS, max(first + 1, int(np.searchsorted(ends, done + most_bytes, "right"))))
        yield first, last, texts.slice(first, last - first)
        first = last


def coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's number among them, and where each text's words begin."""
    codes = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[begins[1:]] - total[begins[:-1]]


class Cache:
    """Results by word, in two generations of about `size` words; words in use stay. `work` takes a list of new words."""

    def __init__(self, work: Callable[[list], list], size: int = 100_000) -> None:
        self.work, self.size, self.young, self.old = work, size, {}, {}

    def __call__(self, keys: list) -> list:
        young, old = self.young.get, self.old.get
        out = [young(k) for k in keys]
        missing = [i for i, v in enumerate(out) if v is None]
        for i in missing:
            out[i] = old(keys[i])
        new = [i for i in missing if out[i] is None]
        for i, v in zip(new, self.work([keys[i] for i in new]), strict=True):
            out[i] = v
        self.young.update((keys[i], out[i]) for i in missing)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return out

    def clear(self) -> None:
        """At a task's end: a worker process goes on to other stages, which need the memory."""
        self.young, self.old = {}, {}
        pa.default_memory_pool().release_unused()
