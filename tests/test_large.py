"""What larger tables and odd inputs showed."""

from __future__ import annotations

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyfold.functions import containers as K
from tallyfold.operators import coverage as C
from tallyfold.plans import fixtures as X
from tallyfold.plans import queries as plans
from tallyfold.streaming import queries as streams

from .conftest import DATA, rows
from .test_containers import shapes


def test_ladder_with_event_ids_that_come_again(spark, tmp_path):
    """the same event ids four weeks later are other scans, not scans delivered again."""
    events = spark.read.parquet(f"{DATA}/events.parquet").filter("user_id < 8")
    events.crossJoin(spark.range(6)).withColumn("ts", F.col("ts") + F.make_dt_interval(F.col("id").cast("int") * 28)).drop("id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(streams.ORACLE_SQL["r1_stream_ladder"]).fetchdf()
    assert rows(streams.r1_stream_ladder(spark, str(tmp_path)).toPandas()) == rows(want)


def test_many_containers_at_once():
    """containers of many chunks are made, read and cut without a step per chunk, byte for byte as one by one."""
    import pyarrow as pa

    sets = [s for s in shapes() if s] + [[5], [7, 8, 9], [1, 2], [0, 65535]] * 50
    random.Random(1).shuffle(sets)
    keys = np.concatenate([(i << 16) + np.array(s, np.int64) for i, s in enumerate(sets)])
    place, packed, n = K.pack_sets(keys)
    assert packed.to_pylist() == [K.pack(np.array(s, np.int64)) for s in sets]
    assert place.tolist() == list(range(len(sets))) and n.tolist() == [len(s) for s in sets]
    assert K.unpack_sets(packed).tolist() == keys.tolist()
    holes = pa.array([None, packed[3].as_py(), None, packed[4].as_py()], pa.binary())[1:]
    assert K.unpack_sets(holes).tolist() == sets[3] + [(2 << 16) + v for v in sets[4]]
    cuts = list(K.slices(packed, values=100_000))
    assert [a for a, _ in cuts] == [0] + [b for _, b in cuts[:-1]] and cuts[-1][1] == len(sets)
    assert len(cuts) > 2 and all(sum(map(len, sets[a:b])) <= 100_000 for a, b in cuts)


def test_ids_by_set(spark):
    """members and others in one pass, with one Python worker after the join."""
    r = random.Random(2)
    a, b = ([r.randrange(-(2**40), 2**40) for _ in range(500)] + list(range(lo, lo + 90_000)) for lo in (0, 50_000))
    x, y = (C.id_containers(spark.createDataFrame([(i,) for i in ids + ids[:200]], "id long").repartition(6)) for ids in (a, b + a[:100]))
    out = C.ids_by_set(x, y)
    known = set(b + a[:100])
    assert sorted(map(tuple, out.collect())) == sorted((i, i in known) for i in set(a))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5


def test_two_pass_tasks_grow_with_the_rows(spark, monkeypatch):
    """the rows of a task stay level, from the join to the last fold."""
    monkeypatch.setattr(X, "ROWS_PER_TASK", 300)
    pages = X.two_pass_pages(spark, DATA)
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 600
    plan = plans.h12_scan_two_pass(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(scan_id") == plan.count("REPARTITION_BY_NUM") > 0


def test_keyed_stream_goes_on_expires_and_repeats(spark, tmp_path):
    """F6, F7, F8: state goes on over batches, ends by event time, and a batch that runs again changes nothing."""
    from tallyfold.sources import ledger
    from tallyfold.streaming import folds

    schema, step, life = "account_id long, observed_at timestamp, scan_id long, status string, keys array<int>", [10, 20, 40], folds.EXPIRE_AFTER * 40
    source, root, state = (f"{tmp_path}/{n}" for n in ("in", "ledger", "state"))
    spark.createDataFrame([], schema).write.parquet(source)
    batches = [[(1, 100, [7]), (2, 100, [8, 9]), (3, 100, [])], [(1, 110, [7]), (2, 111, [9, 8, 9])], [(1, 120, [7]), (1, 130, [7]), (2, 120, [8])], [(4, 121 + life, [1])], [(2, 122 + life, [8]), (1, 122 + life, [7])]]
    want = [{1: 0, 2: 0}, {1: 1, 2: 1}, {1: 2, 2: 0}, {1: 2, 2: 0, 4: 0}, {1: 2, 2: 0, 4: 0}]
    for i, (rows_, stages) in enumerate(zip(batches, want)):
        df = spark.createDataFrame([(a, t, t, "ok", k) for a, t, k in rows_], "account_id long, t long, scan_id long, status string, keys array<int>")
        df.select("account_id", F.timestamp_seconds("t").alias("observed_at"), "scan_id", "status", "keys").coalesce(1).write.mode("append").parquet(source)
        folds.stream_refresh_state(spark.readStream.schema(schema).parquet(source), root, state, step, 0).awaitTermination()
        assert {r["account_id"]: r["stage"] for r in folds.read_refresh_state(spark, root, step).collect()} == stages
    # account 2 began anew: its state ended at 120 + life; with the state it would be a stage higher
    version = ledger.read_commit(spark, root)[0]
    folds.stream_refresh_state(spark.readStream.schema(schema).parquet(source), root, f"{tmp_path}/other", step, 0).awaitTermination()
    assert ledger.read_commit(spark, root)[0] == version


def test_a_scan_moves_its_timers_alone():
    """no list of timers; a timer that stays is not touched, one that moves costs two calls."""
    from types import SimpleNamespace

    from tallyfold.streaming.timers import RefreshTimers

    calls, held = [], []
    proc = RefreshTimers([10, 20])
    proc.handle = SimpleNamespace(registerTimer=lambda t: calls.append(("set", t)), deleteTimer=lambda t: calls.append(("drop", t)))
    proc.state = SimpleNamespace(get=lambda: held[-1] if held else None, update=held.append)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    scan = lambda at: {"at": at, "scan_id": at, "now": "7", "ok": True}
    assert [r["next_due_s"] for r in proc.handleInputRows((1,), iter([scan(100)]), clock)] == [111]
    assert sorted(calls) == [("set", 111_000), ("set", 180_000)]
    calls.clear()
    assert [r["stage"] for r in proc.handleInputRows((1,), iter([scan(105)]), clock)] == [1]
    assert sorted(calls) == [("drop", 111_000), ("drop", 180_000), ("set", 126_000), ("set", 185_000)]
