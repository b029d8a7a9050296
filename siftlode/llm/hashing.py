"""64-bit hashes of words and of runs of words, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a Python worker keeps at most.
BOUND = 500_000


class _Words(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= BOUND:
            self.clear()
        self[word] = value
        return value


_KNOWN, _KNOWN_MORE = _Words(0), _Words(1)
_ODD, _ODD_MORE = (np.random.default_rng(20240229).integers(0, 1 << 63, (2, 64), np.uint64) << np.uint64(1)) | np.uint64(1)


def split(text: str | None) -> list[bytes]:
    """Words as UTF-8: what the six ASCII white-space characters hold apart."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def run_hashes(hashes: np.ndarray, width: int, odd: np.ndarray = _ODD) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words, by its start."""
    n = hashes.size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * odd[0]
    for k in range(1, width):
        out += hashes[k : k + n] * odd[k]
    return mixed(out + np.uint64(width))


def run_checks(words: list[bytes], width: int) -> np.ndarray:
    """32 bits more of each run, from other hashes of its words."""
    more = np.fromiter((_KNOWN_MORE[w] for w in words), np.uint64, len(words))
    return (run_hashes(more, width, _ODD_MORE) >> np.uint64(32)).astype(np.uint32)
