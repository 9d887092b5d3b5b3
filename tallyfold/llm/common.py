"""Helpers shared by the operators: tables, scratch tables, words, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    session gets a folder under /tmp; a cluster must name one that its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/tallyfold"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch between an executor and its Python workers.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what was computed is read again after the loss of an
    executor instead of being computed again.  While it is written, Arrow batches
    are kept small, as whole texts may be long.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    name, small = BATCH_BYTES
    before = spark.conf.get(name)
    spark.conf.set(name, small)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, verdicts: DataFrame, by: str = "kept") -> DataFrame:
    """``docs`` less the documents whose verdict (doc_id, ``by``) is false.

    Of rows that share a doc_id (null included) all go or stay: they stay if one does.
    Columns of any name pass unchanged.
    """
    per = verdicts.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(by).alias("_stay"))
    out = keep(per.filter("not _stay").select("_id"), "rejected")
    out = F.broadcast(out) if out.count() <= BROADCAST_IDS else out
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"))
    return rows.join(out, F.col("_doc").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")


def words_of(text: bytes | None) -> list[bytes]:
    """``bytes.split()`` splits on exactly the six characters excluded by WORD."""
    return text.split() if text else []


#: What operators remember in a Python worker from task to task.
worker_memory: dict = {}


def tidy_worker() -> None:
    """Give back the memory a reused worker holds from earlier tasks, before and after large ones."""
    import ctypes
    import gc

    import pyarrow as pa

    worker_memory.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, rows: int = 512, most_bytes: int = 8 << 20):
    """Cut Arrow batches into pieces of bounded rows and bytes."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes > most_bytes:
            step = max(1, min(rows, int(batch.num_rows * most_bytes / batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def as_bytes(column) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
