"""Streams against their batch forms, with late and repeated rows, and what a batch costs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyfold.operators import coverage as C
from tallyfold.operators import history as H
from tallyfold.sources import ledger
from tallyfold.streaming import folds

from .test_ledger import bytes_moved

SCANS = "account_id long, observed_at timestamp, scan_id string, status string, keys array<long>, login string, node_id string"
START = datetime(2024, 1, 1)
REFRESH = [86_400, 3 * 86_400, 7 * 86_400]


def some_scans(seed: int, accounts: int = 12, days: int = 30) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for a in range(accounts):
        for day in sorted(r.sample(range(days), r.randint(1, 12))):
            ok = r.random() > 0.2
            keys = r.sample(range(5), r.randint(0, 3)) if r.random() > 0.4 else [1, 2]
            rows.append((a, START + timedelta(days=day), f"{a}-{day:02d}", "ok" if ok else "inaccessible", keys if ok or r.random() < 0.5 else None, r.choice(["Ann", "ann", "bob"]), "U" + r.choice("12")))
    return rows


def run(spark, batches: list[list[tuple]], folder, tables=folds.TABLES):
    """Land one batch after the other; returns the root and the bytes (read, written) of each."""
    source, root, state = f"{folder}/in", f"{folder}/ledger", f"{folder}/state"
    spark.createDataFrame([], SCANS).write.parquet(source)
    moved = []
    for rows in batches:
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(source)
        before = bytes_moved(spark)
        folds.stream_history(spark.readStream.schema(SCANS).parquet(source), root, state, REFRESH, tables).awaitTermination()
        moved.append(tuple(b - a for a, b in zip(before, bytes_moved(spark))))
    return root, moved


def same(a, b) -> bool:
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def check(spark, root: str, scans: list[tuple]) -> None:
    whole = spark.createDataFrame(scans, SCANS).dropDuplicates(["account_id", "scan_id"]).cache()
    assert same(folds.read_history(spark, root, "pairs"), folds.history_state(whole))
    good = whole.filter("status = 'ok'").select("account_id", "login", "observed_at", F.col("scan_id").alias("tie"))
    assert same(folds.read_history(spark, root, "logins"), H.login_history(good))
    assert same(folds.read_history(spark, root, "owners"), H.owners(whole))
    assert same(folds.read_history(spark, root, "ladder", REFRESH), H.refresh_ladder(whole, REFRESH))


def test_stream_history_in_order(spark, tmp_path):
    """Six batches in order of time: every table equals its batch form, through a merge."""
    scans = sorted(some_scans(3), key=lambda s: s[1])
    n = -(-len(scans) // 6)
    root, _ = run(spark, [scans[i : i + n] for i in range(0, len(scans), n)], tmp_path)
    check(spark, root, scans)
    levels = [r["level"] for r in ledger.read_commit(spark, root)[1]["tables"]["pairs"]]
    assert 1 in levels and levels.count(0) < ledger.FANOUT


def test_stream_history_late_and_repeated(spark, tmp_path):
    """Scans in any order, some delivered twice, in the same batch or later."""
    scans = some_scans(5)
    mixed = scans + random.Random(1).sample(scans, len(scans) // 4)
    random.Random(2).shuffle(mixed)
    n = -(-len(mixed) // 4)
    root, _ = run(spark, [mixed[i : i + n] for i in range(0, len(mixed), n)], tmp_path)
    check(spark, root, scans)
    log = ledger.read_commit(spark, root)[1]
    fields = SCANS
    assert ledger.read_runs(spark, root, log, "log", fields, ["account_id", "scan_id"]).count() == len(scans)


def test_committed_batch_runs_again(spark, tmp_path):
    """A batch whose checkpoint was lost after its commit changes nothing."""
    scans = some_scans(6)
    root, _ = run(spark, [scans], tmp_path)
    version = ledger.read_commit(spark, root)[0]
    folds.stream_history(spark.readStream.schema(SCANS).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/other", REFRESH).awaitTermination()
    assert ledger.read_commit(spark, root)[0] == version
    check(spark, root, scans)


def shuffled(spark) -> int:
    """Records written to shuffles by all stages so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_batch_shuffles_its_scans_once(spark, tmp_path):
    """Scans move once in a batch, by account; all else that moves is a row an account or login."""
    accounts, days = 300, 20
    rows = lambda start: [(a, START + timedelta(days=d), f"{a}-{d}", "ok", [a, d % 3], f"u{a}", "U") for a in range(accounts) for d in range(start, start + days)]
    root, _ = run(spark, [], tmp_path)
    moved = []
    for batch in (rows(0), rows(days)):
        before = shuffled(spark)
        spark.createDataFrame(batch, SCANS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        folds.stream_history(spark.readStream.schema(SCANS).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/state", REFRESH, ("logins",)).awaitTermination()
        moved.append(shuffled(spark) - before)
    assert accounts * days <= min(moved) <= max(moved) < 2 * accounts * days, moved
    got = folds.read_history(spark, root, "logins").agg(F.count("*"), F.min("first_seen_at"), F.max("last_seen_at"), F.bool_and("present")).first()
    assert tuple(got) == (accounts, START, START + timedelta(days=2 * days - 1), True)


def test_no_ladder_without_a_key(spark, tmp_path):
    """Accounts that never showed a key have no step of the ladder, in the first batch or later; a first key later starts it."""
    day = lambda n: START + timedelta(days=n)
    scan = lambda a, n, keys, status="ok", login="x": (a, day(n), f"{a}-{n:02d}", status, keys, login, "U")
    first = [scan(1, 0, []), scan(1, 1, None), scan(2, 0, [], "inaccessible"), scan(3, 0, []), scan(4, 0, [7]), scan(4, 1, [7]), scan(5, 0, [1])]
    second = [scan(1, 3, []), scan(2, 3, []), scan(3, 3, []), scan(3, 4, [9]), scan(3, 5, [9]), scan(4, 3, [7]), scan(5, 3, [1], "inaccessible"), scan(5, 4, [1])]
    root, _ = run(spark, [first, second], tmp_path)
    assert {r["account_id"] for r in folds.read_history(spark, root, "ladder", REFRESH).collect()} == {3, 4, 5}
    check(spark, root, first + second)


def test_null_logins(spark, tmp_path):
    """A null login is one of its own; after it no login is known to be present, as in the batch form."""
    scan = lambda a, n, login: (a, START + timedelta(days=n), f"{a}-{n}", "ok", [1], login, "U")
    batches = [[scan(1, 0, "ann"), scan(2, 0, None), scan(3, 0, "Bob")], [scan(1, 1, None), scan(2, 1, "x"), scan(3, 1, "bob")], [scan(1, 2, "ANN")]]
    for upto in (2, 3):
        root, _ = run(spark, batches[:upto], f"{tmp_path}/{upto}")
        check(spark, root, [s for b in batches[:upto] for s in b])


def test_batches_cost_level(spark, tmp_path):
    """Ten equal batches on a large history: what each reads and writes stays level."""
    accounts = 20_000
    rows = lambda day, ids: [(a, START + timedelta(days=day), f"{a}-{day}", "ok", [a, a + 1, day], f"u{a}", "U") for a in ids]
    batches = [rows(0, range(accounts))] + [rows(day, range(day, accounts, 200)) for day in range(1, 11)]
    root, moved = run(spark, batches, tmp_path, ("pairs",))
    first = moved[0]
    merging = {i for i in range(1, 11) if (i + 1) % ledger.FANOUT == 0}
    plain = [m for i, m in enumerate(moved[1:], 1) if i not in merging]
    assert max(w for _, w in plain) < 1.5 * min(w for _, w in plain)
    assert max(w for _, w in plain) < first[1] / 3, moved
    reads = [r for r, _ in plain]
    assert max(reads[-2:]) < 2 * max(reads[:2]), moved
    assert folds.read_history(spark, root, "pairs").count() == len({(s[0], key) for rows in batches for s in rows for key in s[4]})


def zero_key_replay(rows: list[tuple], ages: list[int]) -> dict:
    """Stage and times by account, row by row."""
    state: dict = {}
    for a, ts, _, source, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        at = int(ts.timestamp())
        if state.get(a) == "owner":
            continue
        if n > 0:
            state[a] = "owner"
        elif source == "tail":
            stage, first, _, due = state.get(a) or (0, at, at, at + ages[0])
            state[a] = stage, first, at, due
        elif source == "onboarding" and state.get(a):
            stage, first, _, due = state[a]
            state[a] = None if stage >= len(ages) - 1 else (stage + 1, first, at, max(first + ages[stage + 1], at + 300))
    return {a: s for a, s in state.items() if s and s != "owner"}


def test_ladder_of_one_account_over_tasks(spark):
    """An account with nearly all rows is cut into slices; ties of time and accounts that leave and come back."""
    r, ages = random.Random(7), [60, 600, 6000]
    rows = []
    for i in range(3000):
        a = 1 if r.random() < 0.8 else r.randint(2, 40)
        source = r.choice(["tail", "onboarding", "onboarding", "global"])
        rows.append((a, START + timedelta(seconds=r.randrange(20_000)), i, source, int(a > 30 and r.random() < 0.1)))
    df = spark.createDataFrame(rows, "account_id long, observed_at timestamp, scan_id long, source string, n_keys int").repartition(3)
    got = {x["account_id"]: (x["stage"], *(int(x[c].timestamp()) for c in ("first_at", "last_at", "due_at"))) for x in H.zero_key_ladder(df, ages).collect()}
    assert got == zero_key_replay(rows, ages)
    keyed = df.select("account_id", F.unix_timestamp("observed_at").alias("at"), "scan_id", "source", (F.col("n_keys") > 0).alias("has"))
    parts = keyed.filter("account_id = 1").repartitionByRange(4, "account_id", "at", "scan_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 0.5 * sum(p["count"] for p in parts)


def test_quota_of_one_client_over_slices(spark):
    """One client with all rows, dense and sparse times, equal times: many slices, the same rows as a replay."""
    r = random.Random(9)
    times = [r.choice([r.randrange(600), r.randrange(600, 9000), 60 * r.randrange(400)]) for _ in range(2500)]
    rows = [(1, START + timedelta(seconds=t), i) for i, t in enumerate(times)]
    want, begin, n = [], None, 0
    for _, ts, request in sorted(rows, key=lambda x: (x[1], x[2])):
        if begin is None or (ts - begin).total_seconds() >= 60:
            begin, n = ts, 0
        n += 1
        if n > 4:
            want.append((1, request))
    log = spark.createDataFrame(rows, "client long, ts timestamp, request_id long")
    assert sorted(map(tuple, folds.quota_violations(log, 4, 60).collect())) == sorted(want)
    slices = log.select(F.floor(F.unix_micros("ts") / (folds.SLICE_WINDOWS * 60_000_000)).alias("s")).groupBy("s").count().collect()
    assert len(slices) > 15 and max(s["count"] for s in slices) < 0.6 * len(rows)
    assert folds.quota_violations(log.limit(0), 4, 60).count() == 0


def test_places_in_ranges(spark):
    """Ranges of any length, overlapping, of one second, and at powers of two."""
    r = random.Random(4)
    ranges = [(lo, lo + r.choice([0, 1, 3, 4, 7, 8, 9, 63, 64, 1000, 2**20])) for lo in (r.randrange(-50, 5000) for _ in range(80))]
    points = [(i, r.randrange(-60, 8000)) for i in range(500)]
    placed = C.place_in_ranges(spark.createDataFrame(points, "id long, second long"), "second", spark.createDataFrame(ranges, "lo long, hi long"))
    want = sorted((i, lo, hi) for i, at in points for lo, hi in ranges if lo <= at <= hi)
    assert sorted((x["id"], x["lo"], x["hi"]) for x in placed.collect()) == want


def test_time_partitions_have_no_gap_and_no_overlap(spark):
    from tallyfold.plans import queries

    from .conftest import DATA

    rows = queries.QUERIES["j8_time_resolution"](spark, DATA)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert rows.agg(F.sum("ids")).first()[0] == orders.count()
    bounds = orders.agg(F.min(F.unix_timestamp("o_orderdate")), F.max(F.unix_timestamp("o_orderdate"))).first()
    leaves = sorted((r["lo"], r["hi"]) for r in C.bisect_partitions(orders, "o_orderdate", *bounds, 40).collect())
    assert leaves[0][0] == bounds[0] and leaves[-1][1] == bounds[1]
    assert all(a[1] + 1 == b[0] for a, b in zip(leaves, leaves[1:]))
    assert len({hi - lo for lo, hi in leaves}) > 1


def test_due_rows_without_a_new_scan(spark, tmp_path):
    """An account is due when the watermark passes its time, not before, and not if a scan moved it; old state ends."""
    from tallyfold.streaming import timers

    schema = "account_id long, observed_at timestamp, scan_id long, status string, keys array<long>"
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    spark.createDataFrame([], schema).write.parquet(source)
    day = lambda n: START + timedelta(days=n)
    schedule = [86_400, 4 * 86_400]
    batches = [
        [(1, day(0), 1, "ok", [7]), (2, day(0), 2, "ok", [8])],
        [(1, day(1), 3, "ok", [7])],  # account 1 goes up a stage before it is due
        [(9, day(4), 4, "ok", [1])],  # time goes on: account 2 is due
        [(9, day(5), 5, "ok", [1])],
        [(9, day(8), 6, "ok", [2])],  # account 1 is due now
        [(9, day(9), 7, "ok", [2])],
        [(9, day(60), 8, "ok", [2])],
        [(9, day(61), 9, "ok", [2]), (1, day(61), 10, "ok", [7])],  # the state of account 1 has ended
        [(9, day(62), 11, "ok", [2])],
    ]
    with timers.rocks_db(spark):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            due = timers.stream_due(spark.readStream.schema(schema).parquet(source), schedule, "1 second")
            due.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = [(r["account_id"], r["kind"], r["stage"], r["next_due_s"]) for r in spark.read.parquet(f"{out}/*").collect()]
    at = lambda n, a: int(day(n).timestamp()) + a
    assert got.count((2, "due", 0, at(1, 2))) == 1
    assert (1, "due", 0, at(1, 1)) not in got and got.count((1, "due", 1, at(5, 1))) == 1
    assert (1, "scan", 0, at(62, 1)) in got  # begins anew
    assert sum(k == "due" for _, k, _, _ in got) == 2


def test_lookups_read_few_row_groups(spark, tmp_path):
    """A history laid out by key: a few keys read a small part, with the same rows as a whole scan."""
    from tallyfold.operators import lookup as L

    path = f"{tmp_path}/index"
    rows = spark.range(300_000).selectExpr("concat('SHA256:', substr(base64(unhex(sha2(string(id div 3), 256))), 1, 43)) as key", "id as account_id", "sha2(string(id), 256) as pad")
    L.write_index(rows, path)
    index = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    found = index.filter("account_id in (30, 60000, 299999)").collect()
    asked = spark.createDataFrame([(r["account_id"], r["key"]) for r in found], "query_id long, value string")
    before = bytes_moved(spark)[0]
    got = L.read_index(index, asked).collect()
    assert bytes_moved(spark)[0] - before < size / 3
    assert {r["account_id"] // 3 for r in got} == {10, 20_000, 99_999} and len(got) == 9
    assert L.read_index(index, asked.filter("query_id < 0")).count() == 0


def test_digests_of_sets(spark):
    """A million keys in any order, twice: the same digest; one key less: another."""
    from tallyfold.operators import validation as V

    keys = spark.range(1_000_000).selectExpr("'s' as scan_id", "1 as pass", "id as key", "1000000L as expected")
    again = keys.orderBy(F.desc("key")).selectExpr("scan_id", "2 as pass", "key", "expected")
    assert V.scan_two_pass(keys.unionByName(again)).first()["stable"]
    other = again.selectExpr("scan_id", "pass", "if(key = 77, -1, key) as key", "expected")
    assert V.scan_two_pass(keys.unionByName(other)).first()["reason"] == "passes differ"


def test_density_of_uneven_shards(spark):
    """Overlapping, nested, empty and one-id ranges, repeated and missing ids."""
    r = random.Random(11)
    ids = [r.randrange(-100, 3000) for _ in range(4000)] + [5] * 500
    ranges = [(lo, lo + r.choice([0, 1, 10, 500, 5000])) for lo in (r.randrange(-200, 3200) for _ in range(60))] + [(7, 7)] * 2
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    got = C.shard_density(df, spark.createDataFrame(ranges, "lower_id long, upper_id long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = set(ids)
    assert sorted((x["lower_id"], x["upper_id"], x["users"]) for x in got.collect()) == sorted((a, b, sum(a <= i <= b for i in known)) for a, b in ranges)
    assert C.shard_density(df.limit(0), spark.createDataFrame(ranges[:2], "lower_id long, upper_id long")).agg(F.sum("users")).first()[0] == 0


def test_distinct_without_a_horizon(spark, tmp_path):
    """Repeats after any time are dropped, nulls are values, and a batch of new keys needs no exact look-up."""
    from tallyfold.streaming import membership

    schema, keys = "a long, b string", ["a", "b"]
    source, root, state = (f"{tmp_path}/{n}" for n in ("in", "ledger", "state"))
    spark.createDataFrame([], schema).write.parquet(source)
    batches = [[(i, f"x{i % 7}") for i in range(600)] + [(None, None), (None, ""), (1, None)], [(i, "y") for i in range(300)] + [(5, "x5")] * 3, [(i, f"x{i % 7}") for i in range(599, -1, -1)] + [(None, None), (-1, "new")], [(900, None)], [(900, None), (None, "")]]
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(source)
        membership.stream_distinct(spark.readStream.schema(schema).parquet(source), keys, root, state).awaitTermination()
        sizes.append(membership.read_distinct(spark, root, schema).count())
    want = [len({r for some in batches[: i + 1] for r in some}) for i in range(len(batches))]
    assert sizes == want
    assert {tuple(r) for r in membership.read_distinct(spark, root, schema).collect()} == {r for some in batches for r in some}
