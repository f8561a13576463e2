"""Array helpers that run inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Maximal runs of letters and numbers.
WORD = re.compile(r"[^\W_]+")

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word -> 64-bit hash; words are hashed once per worker and batch run."""

    LIMIT = 2_000_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def lower(text: str) -> str:
    """Lower case that never adds combining marks (the dotted capital I would)."""
    return text.replace("İ", "i").lower()


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    found = WORD.findall(lower(text)) if text else []
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words, in order, with repetitions."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * M1
        out ^= out >> np.uint64(29)
    return mix(out)


def strings(column: pa.Array) -> list:
    return column.to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return start, np.diff(np.append(start, len(sorted_keys)))


def order_of(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the first key, then the next; integers from 0 that fit into 64 bits with their index are sorted as one."""
    n = len(keys[0])
    widths = [int(k.max()).bit_length() if n else 0 for k in keys]
    index = max(1, n - 1).bit_length()
    if sum(widths) + index > 64:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.uint64)
    for k, w in zip(keys, widths):
        packed = packed << np.uint64(w) | k.astype(np.uint64)
    packed = packed << np.uint64(index) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << index) - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def all_rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None
