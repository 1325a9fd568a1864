"""Words as numbers and hashes of runs of them, for operators that work on arrays of whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15
#: A worker forgets its words, between chunks, when it has met so many.
WORDS_KEPT = 400_000
ZSTD = pa.Codec("zstd", 1)


class Vocabulary(dict):
    """Word (bytes) -> its number, in order of first sight."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each word, by number."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words: polynomials of runs of 1, 2, 4, ... words put together."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    run, size, out, done = words, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out = run
                else:
                    m = len(words) - done - size + 1
                    out = out[:m] * np.uint64(pow(BASE, size, 1 << 64)) + run[done : done + m]
                done += size
            if done == n:
                return mixed(out)
            run = run[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + run[size:]
            size *= 2


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == n else np.minimum(values[: len(values) - n + size], values[n - size :])


def pack_bytes(data: bytes) -> bytes:
    return ZSTD.compress(data, asbytes=True)


def unpack_bytes(data: bytes, n: int) -> bytes:
    return ZSTD.decompress(data, n, asbytes=True)


def pack(array: np.ndarray) -> bytes:
    return pack_bytes(array.tobytes())


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(unpack_bytes(data, n * np.dtype(kind).itemsize), kind, n)
