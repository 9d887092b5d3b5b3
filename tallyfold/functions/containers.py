"""Compressed sets of ids: a container for each chunk of 2**16 ids.

A container holds the low 16 bits of its chunk's ids in the shortest of three forms,
told by its first byte: an array (two bytes an id), runs (four bytes a run) or a bitmap
(8,192 bytes).  So ids spread thinly over 64 bits take a few bytes each, and a full chunk
five.
"""

from __future__ import annotations

import numpy as np

CHUNK_BITS = 16
ARRAY, RUNS, BITMAP = 0, 1, 2


def pack(lows: np.ndarray) -> bytes:
    """The container of ascending distinct values below 2**16."""
    lows = lows.astype("<u2")
    first = np.flatnonzero(np.diff(lows.astype(np.int64), prepend=-2) != 1)
    sizes = {ARRAY: 2 * len(lows), RUNS: 4 * len(first), BITMAP: 1 << CHUNK_BITS - 3}
    kind = min(sizes, key=lambda k: (sizes[k], k))
    if kind == ARRAY:
        body = lows.tobytes()
    elif kind == RUNS:
        last = np.append(first[1:] - 1, len(lows) - 1) if len(first) else first
        body = np.stack((lows[first], lows[last]), 1).astype("<u2").tobytes()
    else:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[lows] = 1
        body = np.packbits(bits, bitorder="little").tobytes()
    return bytes([kind]) + body


def unpack(container: bytes | None) -> np.ndarray:
    """The ascending values of a container; none for null."""
    if not container:
        return np.zeros(0, np.int64)
    kind, body = container[0], np.frombuffer(container, np.uint8, offset=1)
    if kind == BITMAP:
        return np.flatnonzero(np.unpackbits(body, bitorder="little"))
    values = body.view("<u2").astype(np.int64)
    if kind == ARRAY:
        return values
    low, high = values[::2], values[1::2]
    sizes = high - low + 1
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def merged(a: bytes, b: bytes) -> bytes:
    return pack(np.union1d(unpack(a), unpack(b)))


def less(a: bytes, b: bytes | None) -> bytes | None:
    """Values of ``a`` that ``b`` lacks; null if there are none."""
    left = np.setdiff1d(unpack(a), unpack(b), assume_unique=True) if b else unpack(a)
    return pack(left) if len(left) else None


def common(a: bytes, b: bytes | None) -> bytes | None:
    """Values in both; null if there are none."""
    both = np.intersect1d(unpack(a), unpack(b), assume_unique=True) if b else ()
    return pack(both) if len(both) else None


def holds(container: bytes | None, lows: np.ndarray) -> np.ndarray:
    """Which of some values a container holds: by place in a bitmap, by search elsewhere."""
    if not container:
        return np.zeros(len(lows), bool)
    if container[0] == BITMAP:
        bits = np.frombuffer(container, np.uint8, offset=1)
        return (bits[lows >> 3] >> (lows & 7) & 1).astype(bool)
    values = np.frombuffer(container, "<u2", offset=1)
    if container[0] == ARRAY:
        at = np.minimum(np.searchsorted(values, lows), len(values) - 1)
        return values[at] == lows
    at = np.searchsorted(values[::2], lows, "right") - 1
    return (at >= 0) & (lows <= values[1::2][np.maximum(at, 0)])


# --- many containers at once: values as ascending keys, place << CHUNK_BITS | low ------


def pack_sets(keys: np.ndarray):
    """(places, Arrow array of their containers, sizes) of ascending distinct keys."""
    import pyarrow as pa

    if not len(keys):
        return keys, pa.array([], pa.binary()), keys
    place, lows = keys >> CHUNK_BITS, (keys & (1 << CHUNK_BITS) - 1).astype(np.int64)
    at = np.append(0, np.flatnonzero(np.diff(place)) + 1)
    n = np.diff(np.append(at, len(keys)))
    begins = np.append(True, np.diff(keys) != 1)
    begins[at] = True
    runs = np.add.reduceat(begins.astype(np.int64), at)
    whole = 1 << CHUNK_BITS - 3
    kind = np.where((2 * n <= 4 * runs) & (2 * n <= whole), ARRAY, np.where(4 * runs <= whole, RUNS, BITMAP))
    offsets = np.append(0, np.cumsum(1 + np.choose(kind, (2 * n, 4 * runs, whole))))
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = kind
    of = np.repeat(np.arange(len(n)), n)

    def put(where: np.ndarray, words: np.ndarray) -> None:
        out[where], out[where + 1] = words & 255, words >> 8

    some = np.flatnonzero(kind[of] == ARRAY)
    put(offsets[of[some]] + 1 + 2 * (some - at[of[some]]), lows[some])
    ranks = np.cumsum(begins) - 1
    for mask, word in ((begins, 0), (np.append(begins[1:], True), 2)):
        some = np.flatnonzero(mask & (kind[of] == RUNS))
        put(offsets[of[some]] + 1 + 4 * (ranks[some] - ranks[at[of[some]]]) + word, lows[some])
    for i in np.flatnonzero(kind == BITMAP):
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[lows[at[i] : at[i] + n[i]]] = 1
        out[offsets[i] + 1 : offsets[i + 1]] = np.packbits(bits, bitorder="little")
    return place[at], pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]), n


def _parts(column):
    """(bytes, begin and length of each container) of an Arrow array; a null has no bytes."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8), offsets[:-1], sizes


def _words(body: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` words that follow the first byte of each container, all in one."""
    at = np.repeat(begin + 1 - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
    return body[at].astype(np.int64) | body[at + 1].astype(np.int64) << 8


def unpack_sets(column) -> np.ndarray:
    """Ascending keys of an Arrow array of containers; the place is that in the array."""
    body, begin, size = _parts(column)
    full = np.flatnonzero(size)
    kind, found = body[begin[full]], []
    some = full[kind == ARRAY]
    n = (size[some] - 1) // 2
    found.append((np.repeat(some, n) << CHUNK_BITS) + _words(body, begin[some], n))
    some = full[kind == RUNS]
    n = (size[some] - 1) // 2
    ends = _words(body, begin[some], n)
    low, high = ends[::2], ends[1::2]
    length = high - low + 1
    first = (np.repeat(some, n // 2) << CHUNK_BITS) + low
    found.append(np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum()))
    for i in full[kind == BITMAP]:
        found.append((i << CHUNK_BITS) + np.flatnonzero(np.unpackbits(body[begin[i] + 1 : begin[i] + size[i]], bitorder="little")))
    found = [f for f in found if len(f)]
    return np.sort(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)


def slices(*columns, values: int = 1 << 20):
    """(begin, end) of slices of rows whose containers hold about ``values`` values at most; a row at least."""
    bound = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        body, begin, size = _parts(column)
        full = np.flatnonzero(size)
        kind = body[begin[full]]
        bound[full] += np.where(kind == ARRAY, size[full] // 2, 1 << CHUNK_BITS)
        some = full[kind == RUNS]
        n = (size[some] - 1) // 2
        ends = _words(body, begin[some], n)
        if len(some):
            bound[some] += np.add.reduceat(ends[1::2] - ends[::2] + 1, np.cumsum(n // 2) - n // 2) - (1 << CHUNK_BITS)
    upto, at = np.cumsum(bound), 0
    while at < len(bound):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + values, "right")))
        yield at, end
        at = end


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ascending ``a`` are in the ascending ``b``."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
