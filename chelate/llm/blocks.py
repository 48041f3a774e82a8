"""Blocks of documents whose distinct n-gram hashes are exchanged instead of single tokens.

A scan task cuts its documents into blocks of bounded size. Each block sends every distinct hash
once, sorted and sliced by range, to the bucket that owns this part of the hash space, and gets
one number for each hash back, in the same order. So a shuffle holds at most one entry for each
block and n-gram: a hot n-gram is pre-aggregated before it moves, and hash ranges stay even.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

BLOCK_BYTES = 8 << 20


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, all lowest bytes first: sorted or small numbers then compress well."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back at a task's end: the worker then waits idle beside others that need it."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def cut(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[dict]]]:
    """(block id, rows) of a task; a block ends with the row that reaches ``limit`` bytes of text."""
    base, n, size, rows = TaskContext.get().partitionId() << 32, 0, 0, []
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            size += len(row[text] or b"") + 64
            if size >= limit:
                yield base + n, rows
                n, size, rows = n + 1, 0, []
    if rows:
        yield base + n, rows
    rows = []
    trim()


def number(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each word's number in the block, words in each text, the words by number; cut at ASCII white space."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    seq, lens = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = ((text or b"").lower() if lower else text or b"").split()  # of bytes: A-Z and ASCII white space only
        lens[i] = len(words)
        seq.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
    return np.concatenate(seq) if seq else np.zeros(0, np.uint32), lens, list(known)


def words_of(rows: list[dict], text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: each word's number in the block, words in each row, the words' hashes by number."""
    seq, lens, words = number([r[text] for r in rows])
    return seq, lens, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def slices(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted hashes; bucket i owns the i-th of equal ranges."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64)) // buckets
    return np.concatenate([[0], np.searchsorted(hashes, edges.astype(np.uint64)), [len(hashes)]])


def answer(of: Callable[[np.ndarray, np.ndarray], np.ndarray], hashes: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Combine the values of equal hashes over blocks: for each block its answers, and all distinct ones."""
    if not hashes:
        return [], np.zeros(0)
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = of(inverse, np.concatenate(values)) if len(distinct) else np.zeros(0)
    return np.split(total[inverse], np.cumsum([len(h) for h in hashes])[:-1]), total
