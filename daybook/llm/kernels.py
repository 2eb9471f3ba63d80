"""NumPy kernels over UTF-8 bytes, used inside Arrow functions: word spans, 64-bit hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at a time; a longer document is handled alone.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
SPACED = ~_SPACE
#: Digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[128:] = True

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=U64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


class Hasher:
    """Hashes any span of a buffer from prefix sums, whatever its length."""

    def __init__(self, buffer: np.ndarray):
        up, self.down = _power_tables(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, U64)
        np.cumsum(_BYTE[buffer] * up[:-1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every run of `width` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes."""
    low = size = 0
    for k, text in enumerate(texts):
        if k > low and size + len(text) > limit:
            yield low, k
            low, size = k, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


class Words:
    """The words of some texts: spans into one buffer, hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes], letters: np.ndarray = SPACED):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.zeros(len(self.buffer) + 1, np.int8)
        inside[:-1] = letters[self.buffer]
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return Hasher(self.buffer).spans(self.starts, self.ends)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words; with fewer words the whole sequence is one; none without words."""
    n = len(words)
    if not n:
        return words
    take = min(n, width)
    out = np.full(n - take + 1, take * 0xA24BAED4963EE407 & (1 << 64) - 1, U64)
    for k in range(take):
        out = mix(out ^ words[k : n - take + 1 + k]) + U64(k + 1)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def as_bytes(texts) -> list[bytes]:
    """UTF-8 bytes of an Arrow column of strings; null is empty."""
    return [b"" if t is None else t for t in texts.cast("binary").to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 8 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about `limit` bytes of `text`, so that what a task holds has a bound."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            upto = (ends[low - 1] if low else 0) + limit
            high = max(low + 1, int(np.searchsorted(ends, upto, side="right")))
            yield batch.slice(low, high - low)
            low = high
