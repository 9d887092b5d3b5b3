"""Merkle-tree fingerprints of documents.

A text is a list of sections (separated by blank lines), a section a list of
paragraphs (lines), a paragraph a list of leaves.  Leaves are cut after blanks
by content, about every LEAF_EVERY words (every NEAR_EVERY near the beginning of a
paragraph, so that short texts have several), and an edit moves no cut elsewhere.
Each node is the hash of its children's hashes; the root is a SHA-256.

The fingerprint is text::

    root:<64 hex>;<sections>    sections joined by "/", each
    <node>:<paragraphs>         paragraphs joined by ".", each
    <node>=<leaves>             base64 of the leaves' 48-bit hashes, eight
                                characters a leaf; nodes are 96 bits, sixteen

so it holds the tree's inner nodes, equal texts have equal fingerprints,
unequal roots mean unequal texts, and comparing two trees top-down finds the
branches, and so the places, that differ.  ``likeness`` is the number of leaves
two trees share over the leaves of the larger: 1 for equal texts, 0 for texts
with nothing in common.

Defined cases: a null text is an empty text, whose tree has one empty leaf;
repeated rows give repeated results; rows with equal doc_id stand in a fixed order;
null doc_ids come last in descending order; in a table of one row the next
document is the document itself; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: A cut falls after one blank in this many; near: within so many bytes.
LEAF_EVERY = 8
NEAR_EVERY = 3
NEAR_BYTES = 96
LEAF_CHARS = 8
LEAF_BYTES, NODE_BYTES = 6, 12


def _leaves(line: bytes) -> list[bytes]:
    """Pieces of a line, cut after blanks at which a hash of the three bytes before is 0."""
    if len(line) < 12:
        return [line]
    x = np.frombuffer(line, np.uint8)
    at = np.flatnonzero(x[3:] == 32) + 3
    mixed = (x[at - 1].astype(np.uint32) * 0x9E37 + x[at - 2].astype(np.uint32) * 0x79B9 + x[at - 3].astype(np.uint32) * 0x3C6F) * np.uint32(0x85EBCA6B)
    cuts = (at[(mixed >> 16) % np.where(at < NEAR_BYTES, NEAR_EVERY, LEAF_EVERY) == 0] + 1).tolist()
    if not cuts:
        return [line]
    starts = [0, *cuts]
    return [line[a:b] for a, b in zip(starts, [*cuts, len(line)]) if a < b]


def _line_hash(line: bytes, known: dict) -> tuple[bytes, bytes]:
    """(hash of the paragraph node, the node as shown with its leaves)."""
    got = known.get(line)
    if got is None:
        full = [hashlib.blake2b(leaf, digest_size=16).digest() for leaf in _leaves(line)]
        node = hashlib.blake2b(b"".join(full), digest_size=16, person=b"paragraph").digest()
        shown = base64.b64encode(node[:NODE_BYTES], b"-_") + b"=" + base64.b64encode(b"".join(h[:LEAF_BYTES] for h in full), b"-_")
        known[line] = got = node, shown
    return got


def fingerprint(text: str, known: dict | None = None) -> str:
    """The fingerprint of one text; ``known`` shares paragraphs between calls."""
    known = {} if known is None else known
    sections: list[list[bytes]] = [[]]
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line or not sections[-1]:
            sections[-1].append(line)
        else:
            sections.append([])
    nodes, shown = [], []
    for section in sections:
        got = [_line_hash(line, known) for line in section]
        nodes.append(hashlib.blake2b(b"".join(n for n, _ in got), digest_size=16, person=b"section").digest())
        shown.append(base64.b64encode(nodes[-1][:NODE_BYTES], b"-_") + b":" + b".".join(s for _, s in got))
    root = hashlib.sha256(b"".join(nodes)).hexdigest()
    return f"root:{root};" + b"/".join(shown).decode()


def _tree(print_: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(node, paragraphs) of each section; a paragraph is (node, leaves in one string)."""
    out = []
    for section in print_.partition(";")[2].split("/"):
        node, _, paragraphs = section.partition(":")
        out.append((node, [tuple(p.split("=")) for p in paragraphs.split(".") if p]))
    return out


def leaves_of(print_: str) -> list[str]:
    return [p[i : i + LEAF_CHARS] for _, paragraphs in _tree(print_) for _, p in paragraphs for i in range(0, len(p), LEAF_CHARS)]


def likeness(a: str, b: str) -> float:
    """Shared leaves over the leaves of the larger tree; 1 where the roots are equal."""
    if a[:69] == b[:69]:
        return 1.0
    x, y = leaves_of(a), leaves_of(b)
    if not x or not y:
        return 0.0
    shared = (Counter(x) & Counter(y)).total()
    return min(shared / max(len(x), len(y)), 1 - 1e-9)


def _unmatched(ours: list[str], theirs: list[str]) -> tuple[list[int], list[int]]:
    """Places of hashes in two lists that no equal hash of the other list is matched to, in order."""
    places: dict[str, deque] = {}
    for j, node in enumerate(theirs):
        places.setdefault(node, deque()).append(j)
    left, free, last = [], set(range(len(theirs))), -1
    for i, node in enumerate(ours):
        at = places.get(node, ())
        while at and at[0] <= last:
            at.popleft()
        if at:
            last = at.popleft()
            free.discard(last)
        else:
            left.append(i)
    return left, sorted(free)


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of ``a`` that ``b`` lacks, found top-down.

    Children are aligned by hash, not by place: sections without an equal one are
    compared by their paragraphs, and paragraphs without an equal one by their leaves.
    """
    if a[:69] == b[:69]:
        return []
    ours, theirs = _tree(a), _tree(b)
    sections, others = _unmatched([n for n, _ in ours], [n for n, _ in theirs])
    mine = [(i, j, *p) for i in sections for j, p in enumerate(ours[i][1])]
    held = [p for i in others for p in theirs[i][1]]
    paragraphs, rest = _unmatched([p[2] for p in mine], [n for n, _ in held])
    cut = lambda leaves: [leaves[k : k + LEAF_CHARS] for k in range(0, len(leaves), LEAF_CHARS)]
    own = [(mine[p][0], mine[p][1], k, leaf) for p in paragraphs for k, leaf in enumerate(cut(mine[p][3]))]
    missing, _ = _unmatched([x[3] for x in own], [leaf for p in rest for leaf in cut(held[p][1])])
    return [own[m][:3] for m in missing]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
NO_ID = -(1 << 63)


def _compare(doc_id, text: str, own: str, after: str, after_print: str, known: dict) -> tuple:
    """The result row of a document followed by the text ``after``."""
    n = len(text)
    cut = n // 3
    edited = text[: n - cut] + after[:cut]
    edited_print = own if edited == text else fingerprint(edited, known)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, own, edited_print, likeness(own, edited_print), likeness(own, after_print)


def _walk(batches):
    """Each document of a range against the next; the row marked ``ahead`` ends the range."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    last, over = None, False
    for batch in slices(batches, 256):
        rows, known = [], {}
        for doc_id, packed, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "ahead"))):
            if over:  # further rows ahead that share the doc_id of the first
                continue
            text = unpack(packed).decode("utf-8") if packed else ""
            own = fingerprint(text, known)
            if last is not None:
                rows.append(_compare(*last, text, own, known))
            last, over = (doc_id, text, own), ahead
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], NAMES)


def _ranges(docs: DataFrame, n: int) -> list[tuple[int, int]]:
    """(least, greatest) doc_id of at most ``n`` ranges, highest first; reads doc_id only."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    found = ids.repartitionByRange(n, F.desc("id")).groupBy(F.spark_partition_id()).agg(F.min("id"), F.max("id")).collect()
    return sorted(((r[1], r[2]) for r in found), reverse=True)


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited form (OUT).

    The edited text replaces the last third by the beginning of the next document
    in descending doc_id.  A first look at doc_id alone sets ranges (as many as
    ``spark.sql.shuffle.partitions``, one pair of numbers each comes to the driver);
    then compressed texts are shuffled once, each to its range, and the first
    document of a range also to the range before it, so that every task can walk
    its range alone.
    """
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(docs, n)
    if not bounds:
        return docs.sparkSession.createDataFrame([], OUT)
    lows = np.array([low for low, _ in bounds][::-1], np.int64)
    heads = {high: (k - 1) % len(bounds) for k, (_, high) in enumerate(bounds)}

    def deal(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            ids = [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            packed = [pack(t) if t else None for t in as_bytes(batch.column(1))]
            part = (len(lows) - np.searchsorted(lows, np.array(ids, np.int64), "right")).tolist()
            rows = [(i, z, p, False) for i, z, p in zip(ids, packed, part)]
            rows += [(i, z, heads[i], True) for i, z in zip(ids, packed) if i in heads]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["id", "packed", "part", "ahead"])

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(deal, "id long, packed binary, part int, ahead boolean")
    ordered = dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("ahead", F.desc("id"), "packed")
    return ordered.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "packed", "ahead").mapInArrow(_walk, OUT)
