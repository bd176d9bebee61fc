"""Words and word hashes of many texts at once, on code points in numpy.

A task handles its texts in chunks of about a quarter million characters, so its memory
does not follow the batch; only a single longer text is taken whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        make = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n, base, _U)]))
        up, down = make(_BASE), make(pow(_BASE, -1, 1 << 64))
        if n > 4 * CHUNK:  # a single very long text: not kept
            return up, down
        _tables["up"], _tables["down"] = up, down
    return _tables["up"], _tables["down"]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the executor's heap, and the driver after a fit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """The texts (null: empty) in runs of about ``limit`` characters, each with its first index."""
    at, size, run = 0, 0, []
    for i in range(len(column)):
        text = column[i].as_py() or ""  # one by one: the batch is never whole in Python
        if run and size + len(text) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield at, run
    del run
    give_back()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset of each text with the end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return points, offsets


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross texts: starts, ends, and first run of each text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, wherever the span stands."""
    if "points" not in _tables:
        _tables["points"] = mix(np.arange(1, 0x110001, dtype=_U))
    up, down = _powers(len(points))
    sums = np.zeros(len(points) + 1, dtype=_U)
    np.cumsum(_tables["points"][points] * up[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of ``words[i:i + k]`` for each i; grams that cross texts are for the caller to drop."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, dtype=_U)
    for j in range(k):
        out = out * _U(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def plain_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of digits, a-z and code points from 128 on, in lower-cased text."""
    return runs(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)) | (points >= 128), offsets)


def spaced_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but ASCII white space."""
    return runs((points != 32) & ((points < 9) | (points > 13)), offsets)
