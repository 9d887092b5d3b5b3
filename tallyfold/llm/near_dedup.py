"""Near-duplicate groups by SetSketch banding, likelihood and exact verification.

1. One pass over the texts makes each document's shingle set, a digest of the set
   and its sketch; equal digests are one class, whose smallest doc_id stands for it.
2. Bands of BAND_ROWS registers put classes into buckets; each bucket proposes its
   smallest member against every other one, never all pairs.
3. Proposals whose sizes allow the similarity and whose sketches make it likely are
   verified on the full sets, made again from the whole texts.
4. Links give components.  In a bucket that still holds several components every
   member's sketch is compared with those of the other components, and never with its own
   component's, so that many copies of one text cost what the others in their buckets do;
   what may be similar is one family.  Families are cut into blocks by size, and every two blocks compare
   all their classes on the full sets, so that a pair is found whoever stands first.
5. Components over all links give the groups; the smallest doc_id is kept.

Defined cases: a text without words (or null) has an empty set and no links; rows
with equal doc_id count as one document with the links of all of them; a row with a
null doc_id has no links, a null component and is kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, as_bytes, keep, slices, tidy_worker
from .components import components
from .setsketch import REGISTERS, likely_similarity, set_digests, shingle_sets, sketches

PERCENT = 75
BAND_ROWS = 4
#: An estimate below this is five standard deviations under the similarity asked for.
LEAST_ESTIMATE = 0.56
#: Equal registers of two similar sets are fewer only beyond five standard deviations.
LEAST_EQUAL = 70
#: Larger buckets are cut into parts of about so many members, labels that large into parts of their own.
PART_ROWS = 4096
#: Bounds of a family's block; two blocks are compared in a task.
BLOCK_SHINGLES = 500_000
BLOCK_ROWS = 2000
#: Classes of sizes that a doubling of the size has.
SIZE_CLASSES = 4

SIGNATURES = "doc_id long, n_shingles long, digest binary, registers binary"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, digest and sketch of each whole text; nothing is shuffled."""

    def make(batches):
        import pyarrow as pa

        tidy_worker()

        for batch in slices(batches, 512, 2 << 20):
            hashes, sizes = shingle_sets(as_bytes(batch.column(1)))
            rows = sketches(hashes, sizes)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_digests(hashes, sizes), pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, SIGNATURES)


def _band(i: int) -> Column:
    return F.substring(F.col("registers"), BAND_ROWS * i + 1, BAND_ROWS)


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _propose(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of each bucket's first member with the others.

    ``rows``: keys, id, n.  The first member comes from an aggregation that is
    combined before the shuffle, and is joined back, so Spark can split a bucket
    that holds a large part of all rows.
    """
    heads = rows.groupBy(*keys).agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    pairs = rows.join(heads, keys).filter("id <> head.id")
    return pairs.select(F.col("head.id").alias("a"), F.col("head.n").alias("n_a"), F.col("id").alias("b"), F.col("n").alias("n_b")).filter(_sizes_fit("n_a", "n_b")).distinct()


def _likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule the similarity out."""

    def estimate(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            good = np.concatenate([likely_similarity(a[i : i + 2048], b[i : i + 2048], n_a[i : i + 2048], n_b[i : i + 2048]) for i in range(0, len(a), 2048)]) >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    a = sketch.select(F.col("id").alias("a"), F.col("registers").alias("r_a"))
    b = sketch.select(F.col("id").alias("b"), F.col("registers").alias("r_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; ``pairs`` is a kept table."""
    ids = keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = keep(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")

    def compare(batches):
        import pyarrow as pa

        tidy_worker()

        last, of_last = None, None
        for batch in slices(batches, 256, 2 << 20):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hashes, sizes = shingle_sets(as_bytes(batch.column("t_b")))
            ends = np.cumsum(sizes)
            good = []
            for i, text in enumerate(as_bytes(batch.column("t_a"))):
                if last is None or last != text:
                    last, of_last = text, shingle_sets([text])[0]
                mine = hashes[ends[i] - sizes[i] : ends[i]]
                shared = len(np.intersect1d(of_last, mine, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= PERCENT * (len(of_last) + len(mine) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    t_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b"))
    t_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a"))
    both = pairs.join(t_b, "b").join(t_a, "a").select("a", "b", "t_a", "t_b")
    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    sig = keep(signatures(docs), "signatures")
    linkable = sig.filter("digest is not null and doc_id is not null")
    classes = keep(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c")).select("digest", F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("n"), F.col("c.registers").alias("registers")), "classes")
    copies = linkable.select("doc_id", "digest").join(classes.select("digest", "id"), "digest").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    n_bands = REGISTERS // BAND_ROWS
    bands = classes.select("id", "n", F.posexplode(F.array(*[_band(i) for i in range(n_bands)])).alias("band", "key"))
    first = keep(_propose(bands, ["band", "key"]), "proposals")
    links = keep(_verified(keep(_likely(first, classes), "likely"), docs), "links")
    labels = components(links)
    edges = keep(_family_edges(bands, labels, classes), "family edges")
    if edges.limit(1).count():
        more = _family_links(components(edges), labels, classes, docs)
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(keep(more, "links")))
    labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(copies))
    label = labels.select(F.col("id").alias("doc_id"), "label")
    out = sig.select("doc_id", "n_shingles").join(label, "doc_id", "left").withColumn("component_id", F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _groups(batches, keys: list[str]):
    """Lists of columns, one for each run of equal ``keys`` in sorted batches."""
    at, held = None, []
    for batch in batches:
        columns = batch.to_pydict()
        rows = list(zip(*(columns[k] for k in keys)))
        rest = [columns[c] for c in batch.schema.names if c not in keys]
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j] == rows[i]:
                j += 1
            if rows[i] != at:
                if held:
                    yield held
                at, held = rows[i], [[] for _ in rest]
            for into, column in zip(held, rest):
                into.extend(column[i:j])
            i = j
    if held:
        yield held


def _tasks(df: DataFrame) -> int:
    """Small rows, much work: as many tasks as configured, not as few as the bytes fill."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fit(n: np.ndarray, m: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _spanning(ids: np.ndarray, n: np.ndarray, label: np.ndarray, registers: np.ndarray):
    """Edges that connect all members with a pair of two labels whose sketches may be similar.

    Members of the commonest label have nothing to do with each other: each of them is
    compared with the others only, so the work is the others times all.
    """
    names, place, times = np.unique(label, return_inverse=True, return_counts=True)
    many = place == times.argmax()
    rest, common = np.flatnonzero(~many), np.flatnonzero(many)

    def taken(i: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(members of ``left`` that go with i, the others)."""
        maybe = np.flatnonzero((label[left] != label[i]) & _fit(n[left], n[i]))
        hit = maybe[(registers[left[maybe]] == registers[i]).sum(1) >= LEAST_EQUAL]
        return (left[hit], np.delete(left, hit)) if len(hit) else (hit, left)

    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached:
            i = reached.pop()
            found, rest = taken(i, rest)
            if not many[i]:
                more, common = taken(i, common)
                found = np.concatenate((found, more))
            for k in found.tolist():
                yield int(ids[i]), int(ids[k])
                reached.append(k)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, key, id, n, label) of buckets with two labels or more, with the blocks ``p`` they are compared in.

    A bucket of at most PART_ROWS members is one block.  In a larger one a label with
    PART_ROWS members or more is cut in parts of its own and the other labels share parts;
    two parts meet in a block unless both are of one label.
    """
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = keep(sizes.filter("members > 2 and low <> high").select("band", "key", "members"), "mixed buckets")
    columns = ["band", "key", "p", "id", "n", "label"]
    one = rows.join(sizes.filter(F.col("members") <= PART_ROWS), ["band", "key"]).withColumn("p", F.lit("")).select(columns)
    large = sizes.filter(F.col("members") > PART_ROWS).select("band", "key")
    if large.isEmpty():
        return one
    some = rows.join(large, ["band", "key"])
    counts = some.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("k"))
    own = keep(counts.withColumn("group", F.when(F.col("k") >= PART_ROWS, F.col("label").cast("string")).otherwise("")), "bucket labels")
    groups = own.groupBy("band", "key", "group").agg(F.ceil(F.sum("k") / PART_ROWS).alias("parts"))
    some = some.join(own.filter("group <> ''").select("band", "key", "label", "group"), ["band", "key", "label"], "left").withColumn("group", F.coalesce("group", F.lit("")))
    some = some.join(groups, ["band", "key", "group"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    a, b = (groups.select("band", "key", F.col("group").alias(f"g_{x}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(f"p_{x}")) for x in "ab")
    # groups are paired before their parts: two parts of one label are never made a pair
    pairs = groups.select("band", "key", F.col("group").alias("g_a")).join(groups.select("band", "key", F.col("group").alias("g_b")), ["band", "key"]).filter("g_a < g_b or (g_a = '' and g_b = '')")
    met = pairs.join(a, ["band", "key", "g_a"]).join(b, ["band", "key", "g_b"]).filter("g_a < g_b or p_a <= p_b")
    met = keep(met.withColumn("p", F.concat_ws(",", "g_a", "p_a", "g_b", "p_b")), "met parts")
    sides = met.select("band", "key", F.col("g_a").alias("group"), F.col("p_a").alias("part"), "p").union(met.select("band", "key", "g_b", "p_b", "p")).distinct()
    return one.union(some.join(sides, ["band", "key", "group", "part"]).select(columns))


def _family_edges(bands: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect, bucket by bucket, all classes of two components that may be similar."""

    def connect(batches):
        import pyarrow as pa

        for ids, n, label, registers in _groups(batches, keys):
            rows = np.frombuffer(b"".join(registers), np.uint8).reshape(-1, REGISTERS)
            edges = list(_spanning(np.array(ids), np.array(n), np.array(label), rows))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])

    keys = ["band", "key", "p"]
    met = _blocks(bands.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    met = met.join(classes.select("id", "n", "registers"), ["id", "n"]).select(*keys, "id", "n", "label", "registers")
    return met.repartition(_tasks(bands), *keys).sortWithinPartitions(*keys).mapInArrow(connect, "a long, b long").distinct()


def _similar(side: np.ndarray, ids: np.ndarray, label: np.ndarray, texts: list[bytes | None]):
    """Linked pairs of two blocks (side 0 with side 1) or of one block (side 0 only).

    All intersections are counted: shingles of many sets in a matrix product, the
    others by the pairs of sets that hold them.
    """
    hashes, sizes = shingle_sets(texts)
    full = sizes > 0  # a row of an equal doc_id may be empty
    side, ids, label, sizes = side[full], ids[full], label[full], sizes[full]
    first, total = int((side == 0).sum()), len(ids)
    low = first if first < total else 0
    shared = np.zeros((first, total - low), np.int32)
    known, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(total), sizes)
    many = max(16, total // 16)
    order = np.flatnonzero((times[place] > 1) & (times[place] < many))
    order = order[np.argsort(place[order], kind="stable")]
    token, at = place[order], doc[order]
    for lag in range(1, many):
        k = np.flatnonzero(token[lag:] == token[:-lag])
        if not len(k):
            break
        i, j = at[k], at[k + lag]
        inside = (i < first) & (j >= low)
        np.add.at(shared.reshape(-1), i[inside] * (total - low) + j[inside] - low, 1)
    often = np.flatnonzero(times >= many)
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    column = column[place]
    for c in range(0, len(often), 2048):
        held = (column >= c) & (column < c + 2048)
        cells = np.zeros((total, min(2048, len(often) - c)), np.float32)
        cells[doc[held], column[held] - c] = 1
        shared += (cells[:first] @ cells[low:].T).astype(np.int32)
    for i in range(first):
        js = np.arange(low or i + 1, total)
        both = shared[i, js - low].astype(np.int64)
        good = js[(label[js] != label[i]) & (100 * both >= PERCENT * (sizes[i] + sizes[js] - both))]
        yield from ((int(ids[i]), int(ids[j])) for j in good)


def _family_links(families: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between components, from all pairs of each family, block by block."""

    def compare(batches):
        import pyarrow as pa

        tidy_worker()

        for side, ids, label, texts in _groups(slices(batches, 256, 2 << 20), ["family", "p", "q"]):
            links = list(_similar(np.array(side), np.array(ids), np.array(label), [t and t.encode() for t in texts]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    member = families.select("id", F.col("label").alias("family"))
    rows = member.join(classes.select("id", "n"), "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    weight = F.col("n") + BLOCK_SHINGLES // BLOCK_ROWS
    # a family in one block if it fits, else by size, and equal sizes by a hash
    rows = rows.withColumn("weight", weight).withColumn("class", F.floor(F.log2(F.col("n")) * SIZE_CLASSES))
    whole = rows.groupBy("family").agg(F.sum("weight").alias("whole"))
    parts = rows.groupBy("family", "class").agg(F.sum("weight").alias("some")).join(whole, "family")
    parts = parts.select("family", "class", F.when(F.col("whole") <= BLOCK_SHINGLES, 0).otherwise(F.ceil(F.col("some") / BLOCK_SHINGLES)).alias("parts"))
    block = F.when(F.col("parts") == 0, "").otherwise(F.concat_ws(",", "class", F.pmod(F.xxhash64("id"), F.col("parts"))))
    rows = keep(rows.join(parts, ["family", "class"]).withColumn("block", block).drop("weight", "class", "parts"), "family blocks")
    spans = rows.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    p = spans.select("family", F.col("block").alias("p"), F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    q = spans.select("family", F.col("block").alias("q"), F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    fit = (100 * F.col("p_high") >= PERCENT * F.col("q_low")) & (100 * F.col("q_high") >= PERCENT * F.col("p_low"))
    met = p.join(q, "family").filter((F.col("p") <= F.col("q")) & fit).select("family", "p", "q")
    sides = met.select("family", F.col("p").alias("block"), "p", "q", F.lit(0).alias("side")).union(met.filter("p < q").select("family", F.col("q").alias("block"), "p", "q", F.lit(1).alias("side")))
    ids = keep(rows.select(F.col("id").alias("doc_id")).distinct(), "needed")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    keys = ["family", "p", "q"]
    out = rows.join(texts, "id").join(sides, ["family", "block"]).select(*keys, "side", "id", "label", "text")
    return out.repartition(_tasks(docs), *keys).sortWithinPartitions(*keys, "side").mapInArrow(compare, "a long, b long").distinct()
