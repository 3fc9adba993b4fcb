"""Vectorised hashing in numpy: words, word windows, byte ranges, MinHash."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 17
_powers: list[np.ndarray] = []
_is_space = np.zeros(256, bool)
_is_space[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate((np.ones(1, U64), np.cumprod(np.full(n, b, U64)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * B^j for j < i, modulo 2^64."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of [start, end): equal content has equal hashes wherever it stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(buffer) + 2, bool)
    space[1:-1] = _is_space[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a byte buffer, in segments that end between words."""
    starts, ends = word_spans(buffer)
    if len(buffer) <= _SEGMENT:
        return range_hashes(prefix_sums(BYTE_VALUES[buffer]), starts, ends), starts
    out, first = np.empty(len(starts), U64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _SEGMENT, "right")))
        a, z = starts[first], ends[last - 1]
        out[first:last] = range_hashes(prefix_sums(BYTE_VALUES[buffer[a:z]]), starts[first:last] - a, ends[first:last] - a)
        first = last
    return out, starts


class Words:
    """The words of some documents: hash of each, and the index of each document's first word (one more at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        buffer = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() changes A-Z alone
        self.hashes, starts = word_hashes(buffer)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)
        self.document = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts (word indexes) of all windows of k words that lie in one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        total = self.hashes[:n].copy()
        for j in range(1, k):
            total *= U64(0xC2B2AE3D27D4EB4F)
            total += self.hashes[j : j + n]
        inside = np.flatnonzero(self.document[:n] == self.document[k - 1 :])
        return mix(total[inside]), inside

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows and the document of each; 1 to k-1 words are one shingle, none have none."""
        hashes, starts = self.windows(k)
        owner = self.document[starts]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            extra = np.zeros(len(short), U64)
            for j in range(k - 1):
                longer = np.flatnonzero(self.counts[short] > j)
                extra[longer] = extra[longer] * U64(0xC2B2AE3D27D4EB4F) + self.hashes[self.first[short[longer]] + j]
            hashes, owner = np.concatenate((hashes, mix(extra))), np.concatenate((owner, short))
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        return hashes, owner


def minhash(hashes: np.ndarray, owner: np.ndarray, n: int, permutations: int, seed: int = 0x5EED) -> np.ndarray:
    """n x permutations: the least value of each document's shingles under a*x+b modulo 2^32, a odd; 2^32-1 without shingles."""
    out = np.full((n, permutations), 0xFFFFFFFF, np.uint32)
    if not len(hashes):
        return out
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 1 << 32, permutations, dtype=np.uint32)
    values = (hashes >> U64(32)).astype(np.uint32)
    step = 1 << 16
    begins = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    work = np.empty(min(step, len(values)), np.uint32)
    for at in range(0, len(values), step):  # a block stays in the processor's cache for all permutations
        block = values[at : at + step]
        low, high = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + len(block))
        cuts = np.maximum(begins[low:high] - at, 0)
        who = owner[np.maximum(begins[low:high], at)]
        room = work[: len(block)]
        for p in range(permutations):
            np.multiply(block, a[p], out=room)
            room += b[p]
            out[who, p] = np.minimum(out[who, p], np.minimum.reduceat(room, cuts))
    return out
