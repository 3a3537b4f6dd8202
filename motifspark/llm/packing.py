"""Numpy helpers for operators that send many small facts about texts through a shuffle.

A packed row holds the facts of one batch of documents for one bucket as a few
byte strings, so that the shuffle moves some bytes a fact instead of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
LAST_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(n, _BASE, np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = _INVERSE
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


_powers = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; slice_hash reads the hash of any slice off two of them."""
    up, _ = _powers.of(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers.of(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def batches_of(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of about so many bytes; a null is empty."""
    raw = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
    start, held, size = 0, [], 0
    for i in range(len(raw)):
        held.append(raw[i].as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def put_ids(ids: np.ndarray) -> bytes:
    """Ids in ascending order as differences."""
    return np.diff(ids, prepend=0).astype(np.int64).tobytes()


def get_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.int64))


def put48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def get48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted key columns begins a new group."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new
