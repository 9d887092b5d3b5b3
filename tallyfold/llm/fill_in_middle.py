"""Fill-in-middle transformation of whole texts, and its inverse.

A text is cut into units (lines); hashes of the doc_id choose two cuts and so a
prefix, a middle and a suffix, and the form of the output::

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

A batch is one buffer of bytes.  A scan for unit ends gives the cuts; each part of a
text moves as a whole, so a difference array, which changes only where a part begins,
holds each byte's output shift, its cumulative sum is the shift of every byte, and one
scatter writes all outputs of the batch.  The inverse scans the outputs for the markers,
builds the same shifts from the parts found and gathers the text.  Long buffers are
moved in pieces of PIECE bytes, so index arrays stay small whatever a text's length.

Defined cases: a null or empty text is plain with 0 units and an empty output; a text that
contains a marker is plain; a null doc_id hashes as an empty number; equal rows give equal
rows; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, slices

#: The markers, in the order prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = MARKERS = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Part numbers: what stands in an output of each form, in order.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SEED = "7"
#: Of 100 texts, those transformed, and of 100 of these, those with the suffix first.
RATE, SPM_RATE = 100, 50
#: Bytes moved by one scatter or gather.
PIECE = 1 << 18

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32: the first groups of eight hex digits of a SHA-256."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _moves(parts: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, changes) of the difference array: parts begin at ``parts`` and move to ``target``.

    Empty parts share their place with the next; the changes at one place add up.
    """
    shift = target - parts
    return parts, np.diff(shift, prepend=0)


def _pieces(total: int, places: np.ndarray, changes: np.ndarray):
    """(first, last, target of each byte) of pieces of the buffer: the cumulative sum, piece by piece."""
    carry = 0
    for a in range(0, total, PIECE):
        b = min(a + PIECE, total)
        i, j = np.searchsorted(places, (a, b))
        step = np.zeros(b - a, np.int64)
        np.add.at(step, places[i:j] - a, changes[i:j])
        step[0] += carry
        shift = np.cumsum(step)
        carry = int(shift[-1])
        shift += np.arange(a, b)
        yield a, b, shift


def _spread(sizes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the parts of each text lie in its output.

    sizes: (texts, 3) bytes of prefix, middle and suffix.  -> (offset of each part in its
    output, offset of each marker, size of each output); plain texts have no markers.
    """
    p, m, s = sizes.T
    zero = np.zeros_like(p)
    psm, spm = forms == "psm", forms == "spm"
    at = np.stack([np.where(psm, MARK, np.where(spm, 2 * MARK + s, 0)), np.where(psm | spm, 3 * MARK + p + s, p), np.where(psm, 2 * MARK + p, np.where(spm, MARK, p + m))], 1)
    marks = np.stack([np.where(spm, MARK + s, zero), np.where(psm, MARK + p, zero), 2 * MARK + p + s], 1)
    return at, marks, sizes.sum(1) + 3 * MARK * (psm | spm)


def transform_batch(ids: list, texts: list[bytes], seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> dict:
    """Outputs of a batch: n, form, prefix_chars, middle_chars, and the outputs as (buffer, offsets)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = _starts(length)
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(len(ids), 4)
    # ends of units: after each line feed, and at the end of a text that has none there
    feeds = np.flatnonzero(raw == 10) + 1
    open_end = begin[1:][(length > 0) & ~np.isin(begin[1:], feeds)]
    ends = np.sort(np.concatenate((feeds, open_end)))
    unit = np.searchsorted(ends, begin, "right")
    n = np.diff(unit)
    marked = np.array([any(k in t for k in MARKERS) for t in texts], bool)
    plain = (length == 0) | marked | (drawn[:, 2] % 100 >= rate)
    forms = np.where(plain, "plain", np.where(drawn[:, 3] % 100 < spm_rate, "spm", "psm"))
    both = np.sort(drawn[:, :2] % (n + 1)[:, None], 1)
    reach = np.concatenate((ends, [0]))  # the last entry is never taken by texts with units
    cuts = np.stack([np.where(c > 0, reach[unit[:-1] + c - 1], begin[:-1]) for c in both.T], 1)
    cuts[plain] = begin[1:][plain, None]
    edges = np.column_stack((begin[:-1], cuts, begin[1:]))
    sizes = np.diff(edges, axis=1)
    at, marks, total = _spread(sizes, forms)
    out_begin = _starts(total)
    places, changes = _moves(edges[:, :3].ravel(), (out_begin[:-1, None] + at).ravel())
    out = np.empty(int(out_begin[-1]), np.uint8)
    every, points = edges.ravel(), 0
    before = np.zeros(len(every), np.int64)  # code points of the buffer before each edge
    for a, b, target in _pieces(len(raw), places, changes):
        out[target] = raw[a:b]
        upto = _starts((raw[a:b] & 0xC0) != 0x80)
        i, j = np.searchsorted(every, a), np.searchsorted(every, b, "right")
        before[i:j] = points + upto[every[i:j] - a]
        points += int(upto[-1])
    shown = np.flatnonzero(~plain)
    for column, mark in enumerate(MARKERS):
        where = out_begin[shown] + marks[shown, column]
        for k in range(MARK):
            out[where + k] = mark[k]
    chars = np.diff(before.reshape(-1, 4), axis=1)
    return {"n": n, "form": forms, "plain": plain, "prefix_chars": chars[:, 0], "middle_chars": chars[:, 1], "out": out, "offsets": out_begin}


def _find(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Places of a marker in the buffer."""
    if len(raw) < MARK:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(raw[: len(raw) - MARK + 1] == mark[0])
    return first[(raw[first + 1] == mark[1]) & (raw[first + 2] == mark[2])]


def restore_batch(forms: list[str], outputs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of the texts that outputs and forms stand for."""
    raw = np.frombuffer(b"".join(outputs), np.uint8)
    total = np.fromiter(map(len, outputs), np.int64, len(outputs))
    out_begin = _starts(total)
    forms = np.array(forms, object).astype(str)
    moved = np.flatnonzero(forms != "plain")
    sizes = np.zeros((len(total), 3), np.int64)
    sizes[:, 0] = total
    if len(moved):
        # a transformed text holds no marker, so the first of each kind is the operator's own
        p, s, m = (x[np.searchsorted(x, out_begin[moved])] - out_begin[moved] for x in (np.append(_find(raw, k), out_begin[-1]) for k in MARKERS))
        psm = forms[moved] == "psm"
        sizes[moved] = np.stack([np.where(psm, s, m) - p - MARK, total[moved] - m - MARK, np.where(psm, m, p) - s - MARK], 1)
    begin = _starts(sizes.sum(1))
    at, _, _ = _spread(sizes, forms)
    edges = np.cumsum(np.column_stack((begin[:-1], sizes[:, :2])), 1)
    places, changes = _moves(edges.ravel(), (out_begin[:-1, None] + at).ravel())
    text = np.empty(int(begin[-1]), np.uint8)
    for a, b, source in _pieces(len(text), places, changes):
        text[a:b] = raw[source]
    return text, begin


def _strings(buffer: np.ndarray, offsets: np.ndarray):
    """An Arrow string column over a buffer."""
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """OUT for every row: the transformed text and how it was made; nothing is shuffled."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1024):
            ids = batch.column(0).to_pylist()
            got = transform_batch(ids, [t or b"" for t in as_bytes(batch.column(1))], seed, rate, spm_rate)
            counts = [pa.array(got[c], pa.int64(), mask=got["plain"]) for c in ("prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got["n"], pa.int64()), pa.array(got["form"].tolist(), pa.string()), *counts, _strings(got["out"], got["offsets"])], [c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def restore(outputs: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``output`` and ``form`` alone, after the other columns."""
    schema = T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())])
    form, output = outputs.columns.index("form"), outputs.columns.index("output")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1024):
            text = _strings(*restore_batch(batch.column(form).to_pylist(), as_bytes(batch.column(output))))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)
