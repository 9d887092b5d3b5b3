"""Token ids as wavelet-matrix files.

One file holds the ids of consecutive documents (ascending doc_id).  A wavelet
matrix stores a sequence as one bit-plane per bit of an id, most significant
first; each plane is stably sorted by its bits before the next.  A plane is cut
into blocks of BLOCK_BITS bits, each compressed by itself, and the ones before
every block are stored, so access, rank and select read one block a plane and
count bits inside it only.

File layout, integers little-endian::

    blocks      one zstd frame per block of each plane, packed bits
    samples     one zstd frame, int64 (planes, blocks + 1): ones before each block
    places      one zstd frame, int64 (planes, blocks + 1): offset of each block
    ends        one zstd frame, int64 end position of each document
    doc_ids     one zstd frame, int64 doc_id of each document (null: minimum)
    directory   JSON: n, docs, bits, block bits, zeros per plane, (offset, size) of the four tables
    footer      uint64 directory size, 8-byte magic

Defined cases: a null or empty text is the end id alone; rows with equal doc_id
are written one after the other, ordered by text; rows with a null doc_id come
first; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, keep, scratch, slices
from .files import new_file, open_file
from .tokens import token_ids

END_ID = 0
#: Ids in one file, unless a single document has more.
SHARD_IDS = 6_000_000
#: Pre-tokens whose ids a worker keeps beside the file it builds.
REMEMBERED = 700_000
#: Bits of one block, a multiple of 64.
BLOCK_BITS = 1 << 19
#: Blocks an open file keeps in memory.
OPEN_BLOCKS = 64
MAGIC = b"WVMATRX2"
NO_ID = -(1 << 63)

MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"
DOCS = "part int, file int, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def build_planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes and the number of zeros in each."""
    planes, zeros = [], []
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        plane = ids & ids.dtype.type(1 << b) != 0
        planes.append(np.packbits(plane, bitorder="little"))
        low = ids[~plane]
        zeros.append(len(low))
        ids = np.concatenate((low, ids[plane]))
    return planes, zeros


class WaveletMatrix:
    """Access, rank and select over one file; blocks are read when needed."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a wavelet-matrix file: {uri}")
        length = int.from_bytes(tail[:8], "little")
        head = json.loads(self._read(size - 16 - length, length))
        self.n, self.bits, self.block, self.zeros, self.tables = head["n"], head["bits"], head["block"], head["zeros"], head["tables"]
        self.samples, self.places = (self._table(t).reshape(self.bits, -1) for t in ("samples", "places"))
        self.ends, self.doc_ids = self._table("ends"), self._table("doc_ids")
        self._open: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _table(self, name: str) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(*self.tables[name])), "<i8")

    def _words(self, k: int, block: int) -> np.ndarray:
        """A block of plane ``k`` as 64-bit words."""
        import zstandard

        words = self._open.get((k, block))
        if words is None:
            at, end = self.places[k, block : block + 2].tolist()
            words = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(at, end - at)), "<u8")
            self._open[k, block] = words
            if len(self._open) > OPEN_BLOCKS:
                self._open.popitem(last=False)
        self._open.move_to_end((k, block))
        return words

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block, rest = divmod(i, self.block)
        ones = int(self.samples[k, block])
        if rest:
            words, (w, b) = self._words(k, block), divmod(rest, 64)
            ones += int(np.bitwise_count(words[:w]).sum()) + (int(words[w]) & (1 << b) - 1).bit_count()
        return ones

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        i = int(i)
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            block, rest = divmod(i, self.block)
            bit = int(self._words(k, block)[rest // 64]) >> rest % 64 & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, i: int, j: int) -> tuple[int, int]:
        if token >> self.bits or token < 0:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, i), self._ones(k, j)
            if token >> (self.bits - 1 - k) & 1:
                i, j = self.zeros[k] + a, self.zeros[k] + b
            else:
                i, j = i - a, j - b
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        a, b = self._span(token, 0, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _up(self, k: int, bit: int, wanted: np.ndarray) -> np.ndarray:
        """Positions in plane ``k`` of the bits ``bit`` with the ascending numbers ``wanted``."""
        before = self.samples[k] if bit else np.minimum(np.arange(self.samples.shape[1]) * self.block, self.n) - self.samples[k]
        blocks = np.searchsorted(before, wanted, "right") - 1
        out = np.empty_like(wanted)
        for block in np.unique(blocks).tolist():
            here = blocks == block
            bits = np.unpackbits(self._words(k, block).view(np.uint8), bitorder="little")
            out[here] = block * self.block + np.flatnonzero(bits == bit)[wanted[here] - before[block]]
        return out

    def _positions(self, token: int, numbers: np.ndarray) -> np.ndarray:
        """Positions of the occurrences of ``token`` with ascending ``numbers``."""
        at = self._span(token, 0, self.n)[0] + numbers
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            at = self._up(k, bit, at - self.zeros[k] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self._positions(token, np.array([k], np.int64))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """Ascending positions of ``token``, all looked up together plane by plane."""
        return self._positions(token, np.arange(self.count(token)))

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            raw = b"".join(self._words(k, b).tobytes() for b in range(self.samples.shape[1] - 1))
            plane = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~plane] = ids[: self.zeros[k]]
            up[plane] = ids[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            ids = up
        return ids.astype(np.uint32)


def write_matrix(uri: str, ids: np.ndarray, ends: list[int], doc_ids: list[int | None], bits: int, block_bits: int = BLOCK_BITS) -> None:
    import zstandard

    planes, zeros = build_planes(ids, bits)
    pack, size, at = zstandard.ZstdCompressor(level=1).compress, block_bits // 8, 0
    samples, places, tables = [], [], {}
    with new_file(uri) as out:

        def put(raw: bytes) -> tuple[int, int]:
            nonlocal at
            packed = pack(raw)
            out.write(packed)
            at += len(packed)
            return at - len(packed), len(packed)

        for plane in planes:
            plane = np.concatenate((plane, np.zeros(-len(plane) % 8, np.uint8)))
            parts = [plane[i : i + size] for i in range(0, len(plane), size)]
            places.append([put(p.tobytes())[0] for p in parts] + [at])
            samples.append(np.concatenate(([0], np.cumsum([int(np.bitwise_count(p).sum()) for p in parts]))))
        whole = {"samples": samples, "places": places, "ends": ends, "doc_ids": [NO_ID if x is None else x for x in doc_ids]}
        for name, rows in whole.items():
            tables[name] = put(np.array(rows, "<i8").tobytes())
        head = json.dumps({"n": len(ids), "docs": len(ends), "bits": bits, "block": block_bits, "zeros": zeros, "tables": tables}).encode()
        out.write(head + len(head).to_bytes(8, "little") + MAGIC)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """Write the files and return their manifest (MANIFEST), one row per file.

    Whole texts are shuffled once, into ranges of doc_id; each task closes a file
    at ``shard_ids`` ids, so that its memory does not follow the input.
    """
    folder = folder or scratch(docs.sparkSession, "wavelet")

    def write(batches):
        import pyarrow as pa

        ids_of = token_ids(tokenizer, True, REMEMBERED)
        bits = max(1, (max(ids_of.vocab_size - 1, end_id)).bit_length())
        part, number = TaskContext.get().partitionId(), 0
        held, ends, doc_ids, total, rows = [], [], [], 0, []

        def close():
            nonlocal held, ends, doc_ids, total, number
            if ends:
                path = f"{folder}/part-{part:06d}-{number:04d}.wvm"
                write_matrix(path, np.concatenate(held), ends, doc_ids, bits)
                rows.append((part, number, path, len(ends), total))
                number += 1
                held, ends, doc_ids, total = [], [], [], 0

        for batch in slices(batches, 4096):
            ids, counts = ids_of.encode(as_bytes(batch.column(1)))
            upto = np.cumsum(counts)
            ids = np.insert(ids.astype(np.uint16 if bits <= 16 else np.uint32), upto, end_id)
            begin = 0
            for doc_id, stop in zip(batch.column(0).to_pylist(), (upto + np.arange(1, len(upto) + 1)).tolist()):
                if total and total + stop - begin > shard_ids:
                    close()
                held.append(ids[begin:stop])
                total += stop - begin
                ends.append(total)
                doc_ids.append(doc_id)
                begin = stop
        close()
        for row in rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "file", "path", "n_docs", "n_tokens"), row))], schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return keep(ordered.mapInArrow(write, MANIFEST), "wavelet-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, decoded from the files, in columns DOCS."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part, number, path in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "path"))):
                matrix = WaveletMatrix(path)
                raw = memoryview(matrix.decode().astype("<u4")).cast("B")
                ends = matrix.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n)), pa.array([None if x == NO_ID else x for x in matrix.doc_ids.tolist()], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "place", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "file", "path")
    return files.repartitionByRange(max(1, manifest.count()), "part", "file").mapInArrow(read, DOCS)


def token_index(manifest: DataFrame) -> DataFrame:
    """Documents with ``start``: ids of all documents before, over all files.

    The running sum is over one row per file, never over documents.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    docs = read_token_files(manifest).join(F.broadcast(bases) if manifest.count() <= 100_000 else bases, ["part", "file"])
    return docs.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
