"""Numbers and short texts of one length in few bytes, inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODEC = pa.Codec("zstd")


def closer(values: np.ndarray) -> bytes:
    """The bytes of numbers or of rows of letters, compressed place by place: the first of all, the second of all and so on."""
    if not values.size:
        return b""
    return CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), asbytes=True)


def opened(data: pa.Buffer, n: int, width: int) -> np.ndarray:
    """Back from :func:`closer`: ``n`` rows of ``width`` bytes."""
    if not n * width:
        return np.zeros((n, width), np.uint8)
    return np.ascontiguousarray(np.frombuffer(CODEC.decompress(data, n * width), np.uint8).reshape(width, n).T)


def numbers(data: pa.Buffer, n: int, kind: type) -> np.ndarray:
    return opened(data, n, np.dtype(kind).itemsize).view(kind).reshape(-1)
