"""Merkle manifest of a table of documents: one root, a proof for every row.

A row's leaf is the SHA-256 of its fields.  The leaves of a source, ascending by
doc_id, form a tree in which every ARITY consecutive nodes have one parent; the
sources' roots, in the order of the sources, form a tree of the same kind above
them.  A row's proof lists, level by level, the siblings left and right of its path,
so that a changed row is told from the root without any other row.

Each level is a window: with the nodes of a group in order, a node's siblings stand
at fixed offsets, so lag and lead columns, masked by the node's slot in its run and by
the length of the run, are the proof's step, and the row of a first child hashes the
parent.  Windows cover a block of ARITY ** LEVELS leaves of one group, aligned so that
no run is split; the blocks' tops are the leaves of the next round, until each group
has one node.  A source with a third of all rows is so spread over many blocks, one
shuffle serves LEVELS levels, and a round is ARITY ** LEVELS times smaller than the
one before.

Places in a group come from one range-partitioned sort (its key ends in a row number,
so that equal keys can be split) and the counts of each (partition, group), which are
as many as partitions and groups together; no window covers a whole source.

Defined cases: a null field is written "-"; a null source is a source of its own and
comes first; null doc_ids come first in their source and are not tampered with; rows
that share a doc_id are ordered by their leaf, and equal rows are interchangeable,
each with its own place and proof; a table of one row has its leaf as root and an empty
proof; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, keep

ARITY = 3
#: Levels of the tree that one window partition (ARITY ** LEVELS leaves) holds.
LEVELS = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEPS = "array<struct<left:string,right:string>>"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each its UTF-8 byte count, ":" and value, or "-"."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the last is the leaf of the row without line
    feeds in its text where 2 divides the CRC-32 of the doc_id, else the leaf itself."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    changed = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n"), leaf([*(F.col(c) for c in FIELDS[:-1]), F.replace("text", F.lit("\n"), F.lit(""))]))
    hashed = own.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("leaf"), changed.alias("tampered"))
    return hashed.select("doc_id", "source", "leaf", F.coalesce("tampered", "leaf").alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row in its group (from 0, nulls first), and ``n``, the group's size."""
    spark = rows.sparkSession
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-rows")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = keep(ordered.drop("_row"), "manifest-order")
    # an id is the task's number and, in the lower 33 bits, the row's place in the task
    ordered = ordered.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = ordered.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    per = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_size").over(per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = keep(runs.select("_part", "_group", (before - F.col("_first")).alias("_shift"), F.sum("_size").over(per).alias("n")).withColumnRenamed("_part", "_task"), "manifest-runs")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_IDS else runs
    placed = ordered.join(runs, (F.col("_part") == F.col("_task")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_task", "_group", "_shift")


def _climb(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """``levels`` levels up from nodes (group, pos, n, node), at most LEVELS.

    Adds ``block``, ``steps`` (left and right siblings of each level) and ``top``, the hash
    of the block's node on the last of these levels or of the group's root below it.
    """
    rows = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**LEVELS).cast("long"))
    within = Window.partitionBy(group, "block").orderBy("pos")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"top": F.col("node"), "steps": F.array().cast(_STEPS)})
    for level in range(levels):
        span = ARITY**level
        place, count = F.floor(F.col("pos") / span), F.ceil(F.col("n") / span)
        slot, first = place % ARITY, F.col("pos") % span == 0
        run = F.least(F.lit(ARITY), count - (place - slot))
        live = first & (count > 1)
        # siblings stand whole spans away from a node's first leaf, and so do their first leaves
        left = [F.when(slot >= k, F.lag("top", k * span).over(within)).otherwise("") for k in range(ARITY - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("top", k * span).over(within)).otherwise("") for k in range(1, ARITY)]
        rows = rows.withColumn("_step", F.when(live, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        parent = F.when(live & (slot == 0), F.sha2(F.concat("top", F.col("_step.right")), 256)).otherwise(F.when(first & (count == 1), F.col("top")))
        # what a first leaf knows holds for all leaves of its node, or of its parent
        rows = rows.withColumn("_parent", parent)
        rows = rows.withColumns({"_step": F.last("_step", ignorenulls=True).over(so_far), "top": F.last("_parent", ignorenulls=True).over(so_far)})
        rows = rows.withColumn("steps", F.when(count > 1, F.concat("steps", F.array("_step"))).otherwise(F.col("steps")))
    return rows.drop("_step", "_parent")


def grow(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots): the rows of each round with their steps, and (group, node) of each group's root."""
    rounds, roots = [], []
    while True:
        most, levels = nodes.agg(F.max("n")).first()[0] or 0, 0
        while levels < LEVELS and ARITY**levels < most:
            levels += 1
        rounds.append(keep(_climb(nodes, group, levels), "manifest-round"))
        tops = rounds[-1].filter(F.col("pos") % ARITY**LEVELS == 0)
        tops = tops.select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**LEVELS).cast("long").alias("n"), F.col("top").alias("node"))
        roots.append(tops.filter("n = 1").select(group, "node"))
        nodes = tops.filter("n > 1")
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.unionByName, roots)


def proofs(rounds: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """The rows of the first round with ``steps`` from their node up to the root.

    ``above``: (group, steps, subroot, root) of each group's root, small enough for a
    broadcast if it has at most BROADCAST_IDS rows.  Each round is joined with the blocks'
    tops, which are ARITY ** LEVELS times fewer.
    """
    above = above.withColumnsRenamed({group: "_own", "steps": "_above"})
    above = F.broadcast(above) if above.count() <= BROADCAST_IDS else above
    upper = None
    for rows in reversed(rounds):
        done = rows.filter((F.col("pos") % ARITY**LEVELS == 0) & (F.col("n") <= ARITY**LEVELS)).select(group, "block")
        tops = done.join(above, F.col(group).eqNullSafe(F.col("_own"))).drop("_own")
        if upper is not None:
            tops = tops.unionByName(upper.select(group, F.col("pos").alias("block"), F.col("steps").alias("_above"), "subroot", "root"))
        tops = tops.withColumnsRenamed({group: "_group", "block": "_block"})
        joined = rows.join(tops, (F.col("block") == F.col("_block")) & F.col(group).eqNullSafe(F.col("_group")))
        upper = joined.withColumn("steps", F.concat("steps", "_above")).drop("_group", "_block", "_above", "block", "top")
    return upper


def fold(node: Column, steps: Column) -> Column:
    """The root that a node and the steps of a proof give."""
    return F.aggregate(steps, node, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof in one string, level by level, each level from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered, steps, subroot, root) of every row."""
    rows = numbered(leaves(docs), "source", ["doc_id", "leaf"])
    rounds, roots = grow(rows.withColumnRenamed("leaf", "node"), "source")
    one = numbered(roots.select("source", "node", F.lit(0).alias("all")), "all", ["source"])
    tops, root = grow(one, "all")
    whole = root.select("all", F.array().cast(_STEPS).alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    above = keep(proofs(tops, "all", whole).select("source", "steps", F.col("node").alias("subroot"), "root"), "manifest-sources")
    return proofs(rounds, "source", above).select("doc_id", "source", F.col("node").alias("leaf"), "tampered", "steps", "subroot", "root")


def verify(rows: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from the tampered leaf) and verified to rows of ``manifest``."""
    folded = rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("steps")), 256), "folded_root": fold(F.col("tampered"), F.col("steps"))})
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
