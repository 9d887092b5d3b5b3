"""Placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table,
``(offset + j * skip) mod size``.  Shards take turns, each claiming the first free
slot of its order, until the table is full; a document's slot is a hash of its
doc_id modulo the size.  Adding or removing a shard moves few slots.

The table has a fixed number of slots (at most MOST_SLOTS, checked), so it may be
broadcast whatever the input; placing a document is one lookup.  The main path
is DataFrame functions only.

Defined cases: null doc_ids share a shard, as equal doc_ids do; an empty table gives
an empty result; shards must have distinct names and positive whole weights.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 1_000_003


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Index of the owning shard for every slot; a shard of weight w claims w slots a turn."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or min(weights) < 1 or len(weights) != len(shards):
        raise ValueError("shards need distinct names and positive weights")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for shard, weight in enumerate(weights):
            for _ in range(weight):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % slots
                table[at[shard]] = shard
                left -= 1
                if not left:
                    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) as a DataFrame made from one string of bounded length."""
    text = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(text).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(slots: int = SLOTS, doc_id: str = "doc_id") -> Column:
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """``docs`` with the columns slot and shard; columns of these names are replaced."""
    lookup = table_frame(docs.sparkSession, fill_table(shards, slots, weights))
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(slots))
    return rows.join(F.broadcast(lookup), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = SLOTS, salt: int = 4) -> None:
    """One folder per shard; each shard is written by up to ``salt`` tasks."""
    placed = place(docs, shards, slots)
    placed.repartition("shard", F.col("slot") % salt).write.partitionBy("shard").parquet(path)
