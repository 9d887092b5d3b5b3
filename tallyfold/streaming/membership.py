"""Each key once, for good: a stream deduplicated against everything it ever held.

No watermark lets a key be forgotten.  What was seen is a log-structured table of keys,
and beside it a Bloom filter of fixed size for each bucket of keys.  A batch asks the
filters first: keys they don't know are new; only keys they may know are looked up in the
table.  So memory is a filter a task, and a batch of new keys reads no old ones; a
filter that has filled up only sends more keys to the exact look-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import ledger

BUCKETS = 64
#: Bits of a bucket's filter, and bits set by a key.
FILTER_BITS, SET_BITS = 1 << 20, 4
FILTERS = "bucket int, filter binary"


def _ask(batches, columns: list[str]):
    """Rows of sorted buckets, each bucket's filter first: rows with ``maybe``, then the bucket's filter with all of them."""
    import numpy as np
    import pyarrow as pa

    at, bits, schema = None, None, None

    def kept():
        nulls = [pa.nulls(1, schema.field(c).type) for c in columns]
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([*nulls, pa.array([at], pa.int32()), pa.nulls(1, pa.bool_()), pa.array([packed], pa.binary())], [*columns, "bucket", "maybe", "filter"])

    for batch in batches:
        schema = batch.schema
        bucket = batch.column("bucket").to_numpy()
        ends = [*(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            if end == begin:
                continue
            part = batch.slice(begin, end - begin)
            if at is None or bucket[begin] != at:
                if at is not None:
                    yield kept()
                at, bits = int(bucket[begin]), np.zeros(FILTER_BITS, bool)
            begin = end
            filters = part.column("filter").drop_null().to_pylist()
            for packed in filters:
                bits |= np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
            part = part.filter(pa.compute.is_null(part.column("filter")))
            if part.num_rows:
                one, two = (part.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
                places = (one[:, None] + np.arange(SET_BITS, dtype=np.uint64) * (two[:, None] | np.uint64(1))) % np.uint64(FILTER_BITS)
                maybe = bits[places].all(1)
                bits[places.ravel()] = True
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), part.column("bucket"), pa.array(maybe), pa.nulls(part.num_rows, pa.binary())], [*columns, "bucket", "maybe", "filter"])
    if at is not None:
        yield kept()


def stream_distinct(rows: DataFrame, keys: list[str], root: str, checkpoint: str, writer: str = "distinct"):
    """Fold a stream into the table of its distinct ``keys``; returns the started query.

    ``read_distinct`` gives the table.  Keys are in no order; nulls are values.  A batch
    that runs again finds itself committed.
    """
    fields = rows.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", h1 long, h2 long"
    columns = [*keys, "h1", "h2"]

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, content = ledger.read_commit(spark, root)
        if content.get("batches", {}).get(writer, -1) >= batch_id:
            return
        # equal keys must not meet in a filter: each once, and a null differs from every text
        fresh = batch.select(*keys).distinct().select(*keys, F.xxhash64(*keys, *(F.col(k).isNull() for k in keys)).alias("h1"), F.xxhash64(F.lit(7), *keys).alias("h2"))
        fresh = fresh.withColumn("bucket", F.pmod(F.shiftright("h1", 40), F.lit(BUCKETS)).cast("int"))
        filters = ledger.read_runs(spark, root, content, "filters", FILTERS, ["bucket"])
        both = fresh.unionByName(filters, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.col("filter").desc_nulls_last())
        path = shared_folder(spark, "asked")
        both.mapInArrow(lambda b: _ask(b, columns), f"{schema}, {FILTERS.replace('filter', 'maybe boolean, filter')}").write.parquet(path)
        asked = spark.read.parquet(path)
        hits, known = asked.filter("maybe").select(columns), asked.filter("not maybe").select(columns)
        some = [r[0] for r in hits.select("h1").limit(ledger.FEW_KEYS + 1).collect()]
        if some:
            seen = ledger.read_runs(spark, root, content, "seen", schema, ["h1", "h2", *keys], some if len(some) <= ledger.FEW_KEYS else hits.select("h1").distinct())
            same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
            for k in keys:
                same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
            known = known.unionByName(hits.alias("a").join(seen.alias("b"), same, "left_anti").select(columns))
        after = content | {"batches": content.get("batches", {}) | {writer: batch_id}}
        after = ledger.add_run(after, "seen", ledger.write_run(known.select(columns), root, "seen", version + 1, "h1"))
        after = ledger.add_run(after, "filters", ledger.write_run(asked.filter("filter is not null").select("bucket", "filter"), root, "filters", version + 1, "bucket"))
        ledger.commit(spark, root, version + 1, after)
        ledger.compact(spark, root, {"seen": (schema, ["h1", "h2", *keys]), "filters": (FILTERS, ["bucket"])})

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_distinct(spark: SparkSession, root: str, fields: str, version: int | None = None) -> DataFrame:
    """The distinct keys (``fields``: their schema) of a version."""
    content = ledger.read_commit(spark, root, version)[1]
    names = spark.createDataFrame([], fields).columns
    return ledger.read_runs(spark, root, content, "seen", f"{fields}, h1 long, h2 long", ["h1", "h2", *names]).select(*names)
