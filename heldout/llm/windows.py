"""Words of a text and hashes of its word windows, for work on whole texts inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.default_rng(35)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z in lower case; all other bytes stay, so letters beyond ASCII do too.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64, kept between calls."""
    known = _powers[which]
    if len(known) < n:
        step = np.full(max(n, 2 * len(known)), _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        known = _powers[which] = np.cumprod(step, dtype=np.uint64)
    return known[:n]


class Words:
    """The words of a text and hashes of its windows, from sums over the bytes of the words joined by one space."""

    def __init__(self, text: str | None, lower: bool = False):
        # bytes.split() cuts at exactly the white space meant here: space and the codes 9 to 13.
        data = (text or "").encode("utf-8", "surrogatepass")
        self.words = (data.translate(_LOWER) if lower else data).split()
        self.joined = b" ".join(self.words)
        codes = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(codes == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if self.words else np.zeros(0, np.int64)
        self.ends = np.concatenate([gaps, [len(codes)]]) if self.words else np.zeros(0, np.int64)
        self._codes, self._sums = codes, None

    def __len__(self) -> int:
        return len(self.words)

    def hashes(self, length: int) -> np.ndarray:
        """64-bit hashes of all windows of ``length`` words."""
        if self._sums is None:
            self._sums = np.zeros(len(self._codes) + 1, np.uint64)
            np.cumsum(_BYTE[self._codes] * _power("up", len(self._codes)), out=self._sums[1:])
        count = len(self) - length + 1
        first, last = self.starts[:count], self.ends[length - 1 :]
        h = (self._sums[last] - self._sums[first]) * _power("down", len(self._codes) + 1)[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def digests(self, at: np.ndarray, length: int) -> list[bytes]:
        """128-bit hashes of the windows of ``length`` words that begin at the words ``at``."""
        joined, digest = self.joined, xxhash.xxh3_128_digest
        return [digest(joined[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist(), strict=True)]
