"""SetSketch registers of shingle sets, and what can be told from them.

Register j of a set holds ``floor(1 - log_b(x))`` for the least of exponentially
distributed hashes ``x`` (rate ``a``) of its elements, cut to one byte.  The sketch
of a union is the register-wise maximum.  Two registers of sets with Jaccard
similarity J are equal with a probability just above J, which is what banding
needs; from how many are equal, higher or lower, and from the sizes of both sets,
J is estimated by maximum likelihood.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
REGISTERS = 128
BASE, RATE, TOP = 1.08, 20.0, 255

_byte = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_factor = np.random.default_rng(11).integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_shift = np.random.default_rng(13).integers(1, 1 << 63, REGISTERS, np.uint64)
_step = 0x5851F42D4C957F2D
_back = pow(_step, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(step: int, n: int) -> np.ndarray:
    """1, step, step**2, ... modulo 2**64."""
    key = f"{step}"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), step, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts one after the other, sizes).

    Letters A-Z are lower-cased; a shingle is ``width`` words joined by one blank;
    a text with fewer words has them all as its one shingle, a text without words none.
    """
    words = [t.lower().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    buffer = np.frombuffer(b" ".join(w for ws in words for w in ws), np.uint8)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.concatenate((np.flatnonzero(buffer == 32), [len(buffer)]))
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_byte[buffer] * _power(_step, len(buffer))[: len(buffer)], out=sums[1:])
    offsets = np.concatenate(([0], np.cumsum(counts)))
    shingles = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    where = np.concatenate(([0], np.cumsum(shingles)))
    first = np.arange(int(where[-1])) - np.repeat(where[:-1], shingles) + np.repeat(offsets[:-1], shingles)
    last = np.minimum(first + width, np.repeat(offsets[1:], shingles)) - 1
    s, e = starts[first], ends[last]
    hashes = _mix((sums[e] - sums[s]) * _power(_back, len(buffer))[s] + (e - s).astype(np.uint64))
    for a, b in zip(where[:-1].tolist(), where[1:].tolist()):
        hashes[a:b].sort()
    distinct = np.ones(len(hashes), bool)
    distinct[1:] = hashes[1:] != hashes[:-1]
    full = where[:-1][shingles > 0]
    distinct[full] = True
    kept = np.concatenate(([0], np.cumsum(distinct)))
    return hashes[distinct], kept[where[1:]] - kept[where[:-1]]


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (rows by REGISTERS, one byte each); a row of zeros for an empty set."""
    out = np.zeros((len(sizes), REGISTERS), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    least = np.empty((len(full), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat(hashes * _factor[j] + _shift[j], starts)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)
    return out


def set_digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each whole set, None for an empty one."""
    ends = np.cumsum(sizes).tolist()
    return [hashlib.blake2b(hashes[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, sizes.tolist())]


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that one set's register is higher: p(x) = -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


_grid = np.linspace(0.0, 1.0, 51)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood estimate of J for rows of registers and set sizes."""
    higher, lower = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - higher - lower
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_grid[None, :], np.minimum(u / v, v / u))
    p, q = _share(u - v * j), _share(v - u * j)
    tiny = 1e-12
    score = higher[:, None] * np.log(p + tiny) + lower[:, None] * np.log(q + tiny) + equal[:, None] * np.log(np.maximum(1 - p - q, tiny))
    return j[np.arange(len(j)), score.argmax(1)]
