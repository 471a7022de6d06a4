"""Compact columns of whole numbers and words, for rows that are shuffled."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard


def gives_back(run: Callable) -> Callable:
    """A function of batches, or of one or two tables, after which its worker returns freed memory.

    Workers live on, idle, beside those of the next stage.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    @wraps(run)
    def stream(batches):
        yield from run(batches)
        release()

    @wraps(run)
    def whole(rows):
        result = run(rows)
        release()
        return result

    @wraps(run)
    def both(left, right):
        result = run(left, right)
        release()
        return result

    if inspect.isgeneratorfunction(run):
        return stream
    return whole if len(inspect.signature(run).parameters) == 1 else both


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes, compressed; small numbers cost little."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: Sequence[bytes]) -> bytes:
    """Words without a line feed inside."""
    return squeeze(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    whole = unsqueeze(data)
    return whole.split(b"\n") if whole else []


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes ``start .. start + count - 1`` of every range, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as byte planes of their differences, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    steps = np.diff(values, prepend=np.zeros(1, "<u8"))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
