"""Streams that keep the derived tables up to date.

Each stream has a batch form elsewhere in the library that gives the same result
over the same rows; the tests compare the two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.history import login_history, ownership_history, shown_keys
from ..operators.schedule import id_stagger, schedule_lookup
from ..sources import ledger

PAIRS = "account_id long, key long, first_seen_at timestamp, last_seen_at timestamp, present boolean, removed_at timestamp"
LOGINS = "account_id long, login string, first_seen_at timestamp, last_seen_at timestamp, present boolean"
#: What is known of an account: its last scan, its row among the owners, its step of the ladder.
ACCOUNTS = """account_id long, last_at timestamp, last_scan string, shown array<long>, first_seen_at timestamp, last_seen_at timestamp,
  login string, node_id string, inaccessible boolean, stage int, last_changed_at timestamp, last_scan_at timestamp"""
KEYS = {"pairs": (PAIRS, ["account_id", "key"]), "logins": (LOGINS, ["account_id", "login"]), "accounts": (ACCOUNTS, ["account_id"])}
TABLES = ("pairs", "logins")


def history_state(scans: DataFrame) -> DataFrame:
    return ownership_history(scans).select("account_id", "key", "first_seen_at", "last_seen_at", "present", "removed_at")


def _differs(values: dict[str, Column]) -> Column:
    """Whether a row is new or one of its values isn't the held one; ``values``: held column by name."""
    return ~reduce(Column.__and__, [F.col(name).eqNullSafe(held) for name, held in values.items()])


def fold_history(state: DataFrame, batch: DataFrame, changed: bool = False) -> DataFrame:
    """Pairs after a batch whose scans are all later than each account's last one, or only those it ``changed``.

    Pairs the batch doesn't show and that were present are removed at the account's
    first scan of the batch; pairs it shows take their end from the batch, their
    beginning from the state.
    """
    values = ("first_seen_at", "last_seen_at", "present", "removed_at")
    first = batch.groupBy("account_id").agg(F.min("observed_at").alias("_first"))
    new = history_state(batch).select("account_id", "key", *[F.col(c).alias(f"n_{c}") for c in values])
    held = state.select("account_id", "key", *[F.col(c).alias(f"s_{c}") for c in values])
    rows = held.join(new, ["account_id", "key"], "full_outer").join(first, "account_id", "left")
    seen, gone = F.col("n_first_seen_at").isNotNull(), F.col("s_present") & F.col("_first").isNotNull()
    removed = F.when(seen, F.col("n_removed_at")).when(gone, F.col("_first")).otherwise(F.col("s_removed_at"))
    rows = rows.withColumns(
        {
            "first_seen_at": F.least("s_first_seen_at", "n_first_seen_at"),
            "last_seen_at": F.greatest("s_last_seen_at", "n_last_seen_at"),
            "present": removed.isNull(),
            "removed_at": removed,
        }
    )
    if changed:
        rows = rows.filter(_differs({c: F.col(f"s_{c}") for c in values}))
    return rows.select("account_id", "key", *values)


def fold_logins(state: DataFrame, batch: DataFrame, latest: DataFrame) -> DataFrame:
    """Logins that a batch of later good scans adds or changes; ``state``: those of its accounts.

    ``latest``: (account_id, latest), the login of each account's last good scan of the batch.
    """
    keys, values = ["account_id", "login"], ("first_seen_at", "last_seen_at", "present")
    new = batch.groupBy(*keys).agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))
    held = state.select(*keys, "first_seen_at", "last_seen_at", *[F.col(c).alias(f"s_{c}") for c in values])
    rows = new.unionByName(held, allowMissingColumns=True).repartition("account_id")
    rows = rows.groupBy(*keys).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), *[F.max(f"s_{c}").alias(f"s_{c}") for c in values])
    rows = rows.join(latest.withColumn("_seen", F.lit(True)), "account_id", "left")
    rows = rows.withColumn("present", F.when(F.col("_seen"), F.lower("login") == F.lower("latest")).otherwise(F.col("s_present")))
    return rows.filter(_differs({c: F.col(f"s_{c}") for c in values})).select(*keys, *values)


def account_batches(batch: DataFrame) -> DataFrame:
    """Per account of a batch, what its scans do whatever was known before: one row.

    Its first and last scan, when it first shows keys, its last good scan, how many are good,
    and its last change of keys after its first scan with the good scans up to it.
    """
    by_account = Window.partitionBy("account_id").orderBy("observed_at", "scan_id")
    rows = batch.select("account_id", "observed_at", "scan_id", (F.col("status") == "ok").alias("ok"), F.sort_array(F.array_distinct(shown_keys())).alias("shown"), "login", "node_id")
    rows = rows.withColumns({"before": F.lag("shown").over(by_account), "oks": F.count(F.when(F.col("ok"), 1)).over(by_account.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    scan, changed = F.struct("observed_at", "scan_id", "shown", "ok"), F.col("ok") & (F.col("before") != F.col("shown"))
    return rows.groupBy("account_id").agg(
        F.min(scan).alias("oldest"),
        F.max(scan).alias("newest"),
        F.min(F.when(F.size("shown") > 0, F.col("observed_at"))).alias("shows"),
        F.max(F.when(F.col("ok"), F.struct("observed_at", "scan_id", "login", "node_id"))).alias("good"),
        F.count_if("ok").alias("n_ok"),
        F.max(F.when(changed, F.struct("observed_at", "scan_id", "oks"))).alias("change"),
    )


def with_known(batches: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``account_batches`` beside the accounts' rows of ``state``, whose columns begin with s_."""
    return batches.join(state.select("account_id", *[F.col(c).alias(f"s_{c}") for c in state.columns if c != "account_id"]), "account_id", "left")


def fold_accounts(met: DataFrame, schedule: list[int]) -> DataFrame:
    """ACCOUNTS after a batch of later scans, from rows of ``with_known``.

    The first scan of the batch is compared with the last one known; without any change the
    run of good scans goes on from the known stage, if the account ever showed a key.
    """
    empty, top = F.array().cast("array<long>"), max(len(schedule) - 1, 0)
    at_first = F.col("oldest.ok") & (F.coalesce("s_shown", empty) != F.col("oldest.shown"))
    later = F.col("change").isNotNull()
    changed = later | F.coalesce(at_first, F.lit(False))
    moved = changed | F.col("s_first_seen_at").isNotNull() & (F.col("n_ok") > 0)
    # good scans since the last change, itself left out; a change is a good scan
    since = F.col("n_ok") - F.when(later, F.col("change.oks")).otherwise(F.lit(1))
    stage = F.when(changed, since).when(moved, F.col("s_stage") + F.col("n_ok")).otherwise(F.col("s_stage"))
    has_good = F.col("good").isNotNull()
    return met.select(
        "account_id",
        F.col("newest.observed_at").alias("last_at"),
        F.col("newest.scan_id").alias("last_scan"),
        F.col("newest.shown").alias("shown"),
        F.coalesce("s_first_seen_at", "shows").alias("first_seen_at"),
        F.coalesce("good.observed_at", "s_last_seen_at").alias("last_seen_at"),
        F.when(has_good, F.col("good.login")).otherwise(F.col("s_login")).alias("login"),
        F.when(has_good, F.col("good.node_id")).otherwise(F.col("s_node_id")).alias("node_id"),
        (~F.col("newest.ok")).alias("inaccessible"),
        # least() would pass over the null of an account that never showed a key
        F.when(stage > top, F.lit(top)).otherwise(stage).cast("int").alias("stage"),
        F.when(later, F.col("change.observed_at")).when(changed, F.col("oldest.observed_at")).otherwise(F.col("s_last_changed_at")).alias("last_changed_at"),
        F.when(moved, F.col("good.observed_at")).otherwise(F.col("s_last_scan_at")).alias("last_scan_at"),
    )


def stream_history(scans: DataFrame, root: str, checkpoint: str, schedule: list[int], tables: tuple[str, ...] = TABLES, writer: str = "history"):
    """Fold a stream of scans into log-structured tables; returns the started query.

    Tables: ``accounts`` (owners and refresh ladder), and of ``tables`` key pairs and logins.
    A batch reads the rows of its accounts, folds its scans into them and adds a run of
    the rows that changed to each table, and its scans to the log; one commit publishes
    all of it.  What a batch reads and writes follows the accounts it holds.

    The log is read only for accounts with a scan not later than their last one: scans
    delivered again are dropped by their scan_id, and if late ones are left, the account is
    folded again from its log.  A batch that runs again finds itself committed and does nothing.
    """
    log_schema = scans.schema
    log_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log_schema.fields)
    log_keys = ["account_id", "scan_id"]

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, content = ledger.read_commit(spark, root)
        if content.get("batches", {}).get(writer, -1) >= batch_id:
            return
        # one shuffle: what follows is by account
        fresh = batch.select(*log_schema.names).repartition("account_id").persist()
        held_rows = [fresh]
        if (fresh.groupBy(*log_keys).count().agg(F.max("count")).first()[0] or 0) > 1:
            fresh = fresh.dropDuplicates(log_keys).persist()
            held_rows.append(fresh)
        batches = account_batches(fresh).persist()
        some = [r[0] for r in batches.select("account_id").limit(ledger.FEW_KEYS + 1).collect()]
        held = some if len(some) <= ledger.FEW_KEYS else batches.select("account_id")

        def state(name: str, only) -> DataFrame:
            return ledger.read_runs(spark, root, content, name, *KEYS[name], only)

        met = with_known(batches, state("accounts", held)).withColumn("_late", F.struct("oldest.observed_at", "oldest.scan_id") <= F.struct("s_last_at", "s_last_scan")).persist()
        held_rows += [batches, met]
        late, on_time, again, fresh_log = met.filter("_late").select("account_id"), fresh, None, fresh
        if n_late := met.agg(F.count_if("_late")).first()[0]:
            log = ledger.read_runs(spark, root, content, "log", log_fields, log_keys, [r[0] for r in late.collect()] if n_late <= ledger.FEW_KEYS else late)
            new = fresh.join(late, "account_id", "left_semi").join(log.select(*log_keys), log_keys, "left_anti").select(*fresh.columns)
            on_time = fresh.join(late, "account_id", "left_anti")
            again = log.join(new.select("account_id").distinct(), "account_id", "left_semi").unionByName(new).persist()
            held_rows.append(again)
            fresh_log = on_time.unionByName(new)
        met = met.filter(~F.coalesce("_late", F.lit(False)))

        def before(name: str) -> DataFrame:
            rows = state(name, held)
            return rows if again is None else rows.join(late, "account_id", "left_anti")

        def pairs() -> DataFrame:
            rows = fold_history(before("pairs"), on_time, changed=True)
            return rows if again is None else rows.unionByName(history_state(again))

        def logins() -> DataFrame:
            latest = met.filter("good is not null").select("account_id", F.col("good.login").alias("latest"))
            rows = fold_logins(before("logins"), on_time.filter("status = 'ok'"), latest)
            return rows if again is None else rows.unionByName(login_history(again.filter("status = 'ok'").select("account_id", "login", "observed_at", F.col("scan_id").alias("tie"))))

        known = fold_accounts(met, schedule)
        if again is not None:
            known = known.unionByName(fold_accounts(with_known(account_batches(again), ledger.nothing(spark, ACCOUNTS)), schedule))
        new_rows = {"log": fresh_log, "accounts": known}
        new_rows |= {name: {"pairs": pairs, "logins": logins}[name]() for name in tables}
        after = content | {"batches": content.get("batches", {}) | {writer: batch_id}}
        for name, rows in new_rows.items():
            after = ledger.add_run(after, name, ledger.write_run(rows, root, name, version + 1, "account_id"))
        ledger.commit(spark, root, version + 1, after)
        for rows in held_rows:
            rows.unpersist()
        ledger.compact(spark, root, {"log": (log_fields, log_keys), "accounts": KEYS["accounts"]} | {name: KEYS[name] for name in tables})

    return scans.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, root: str, table: str, schedule: list[int] | None = None, version: int | None = None, only: list | None = None) -> DataFrame:
    """``pairs``, ``logins``, ``owners`` or ``ladder`` (with due times of ``schedule``) of a version."""
    content = ledger.read_commit(spark, root, version)[1]
    if table in ("owners", "ladder"):
        rows = ledger.read_runs(spark, root, content, "accounts", *KEYS["accounts"], only)
        if table == "owners":
            return rows.filter("first_seen_at is not null").select("account_id", "first_seen_at", "last_seen_at", "login", "node_id", "inaccessible")
        due = F.timestamp_seconds(id_stagger(F.unix_timestamp("last_scan_at") + schedule_lookup(schedule, F.col("stage")), F.col("account_id")))
        return rows.filter("stage is not null").select("account_id", "stage", "last_changed_at", "last_scan_at", due.alias("next_due_at"))
    return ledger.read_runs(spark, root, content, table, *KEYS[table], only)


def stream_rates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per-minute totals; data later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "n")


def recent(rates: DataFrame, days: int = 7) -> DataFrame:
    """The newest ``days`` of a table of rates by minute; older ones are not kept."""
    last = rates.agg(F.max("minute").alias("_last"))
    return rates.join(F.broadcast(last), F.col("minute") > F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def stream_highwater(events: DataFrame, key: str, value: str) -> DataFrame:
    """Highest value seen per key; run in complete or update mode."""
    return events.groupBy(key).agg(F.max(value).alias(value))


def stream_dedupe(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "40 days") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


#: Length of a slice of a client's log, in windows.
SLICE_WINDOWS = 8


def _slice_exits(batches, width: int):
    """Per (client, slice) of sorted rows: what each way into the slice leads to.

    A window opened before the slice ends somewhere in its first ``width``; the first
    request from then on opens a window, and the slice's other windows follow.  Every
    request up to there is followed as such an entry; entries whose windows meet in one
    request go on as one, so a request costs what it merges.  Rows out: (client, slice,
    entry, start, n), the last window's start and requests in the slice, by entry; and
    one row of null entry with all requests of the slice.
    """
    import pyarrow as pa

    key, total, first_end, newest = None, 0, 0, None
    chains: list[list] = []  # [start of the window, requests before it, entries], by start

    def done():
        out = [(*key, None, None, total)] + [(*key, e, start, total - before) for start, before, entries in chains for e in entries]
        client, part, entry, start, n = zip(*out)
        kinds = (pa.int64(),) * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip((client, part, entry, start, n), kinds)], ["client", "slice", "entry", "start", "n"])

    for batch in batches:
        for client, part, t in zip(*(batch.column(c).to_pylist() for c in ("client", "slice", "t"))):
            if key != (client, part):
                if key is not None:
                    yield done()
                key, total, chains, newest = (client, part), 0, [], None
                first_end = (part * SLICE_WINDOWS + 1) * width  # any window from before has ended by then
            if chains and chains[0][0] + width <= t:
                ended = [c for c in chains if c[0] + width <= t]
                chains = [c for c in chains if c[0] + width > t]
                chains.append([t, total, [e for c in ended for e in c[2]]])
            if newest is None or newest < first_end and newest != t:
                if chains and chains[-1][0] == t:
                    chains[-1][2].append(t)
                else:
                    chains.append([t, total, [t]])
                newest = t
            total += 1
    if key is not None:
        yield done()


def _slice_states(batches, width: int):
    """(client, slice, start, n): the window open at each slice's begin, from sorted rows of ``_slice_exits``."""
    import pyarrow as pa

    client_at = part_at = None
    start = n = None  # the window that is open, and its requests so far
    total, left = 0, None
    out: list[tuple] = []

    def leave():
        """What the slice just read does to the open window."""
        nonlocal start, n
        if left is not None:
            start, n = left
        elif part_at is not None and start is not None:
            n += total

    for batch in batches:
        for client, part, entry, begun, count in zip(*(batch.column(c).to_pylist() for c in ("client", "slice", "entry", "start", "n"))):
            if (client, part) != (client_at, part_at):
                leave()
                if client != client_at:
                    start = n = None
                client_at, part_at, left = client, part, None
                out.append((client, part, start, n))
            if entry is None:
                total = count
            elif left is None and (start is None or entry >= start + width):
                left = begun, count
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["client", "slice", "start", "n"])
            out = []


def quota_violations(log: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Requests above the limit of windows that open at a client's first request.

    ``log``: (client, ts, request_id).  A window ends ``seconds`` after it opened and
    the next request opens another one, so windows are each client's own and hang on all
    before.  A segmented scan: the log of a client is cut in slices of SLICE_WINDOWS
    windows' length; each slice is summed up as a function from the window that is open at
    its begin to the one open at its end; these small rows are composed in order for each
    client; then every slice is walked alone from its own state.  A client with all rows
    is so spread over its slices.
    """
    width = seconds * 1_000_000
    rows = log.select("client", "request_id", F.unix_micros("ts").alias("t"))
    keys = ["client", "slice"]
    rows = rows.withColumn("slice", F.floor(F.col("t") / (SLICE_WINDOWS * width)).cast("long"))
    exits = rows.select("client", "slice", "t").repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(lambda b: _slice_exits(b, width), "client long, slice long, entry long, start long, n long")
    states = exits.repartition("client").sortWithinPartitions("client", "slice", F.col("entry").asc_nulls_first()).mapInArrow(lambda b: _slice_states(b, width), "client long, slice long, start long, n long")

    def walk(batches):
        import pyarrow as pa

        begin, n = None, 0
        for batch in batches:
            over = []
            for t, start, before in zip(*(batch.column(c).to_pylist() for c in ("t", "start", "n"))):
                if t is None:
                    begin, n = start, before or 0
                    over.append(False)
                    continue
                if begin is None or t - begin >= width:
                    begin, n = t, 0
                n += 1
                over.append(n > limit)
            yield batch.select(["client", "request_id"]).filter(pa.array(over, pa.bool_()))

    # a slice's state stands before its requests
    both = rows.select(*keys, "t", "request_id").unionByName(states, allowMissingColumns=True)
    ordered = both.repartition(*keys).sortWithinPartitions(*keys, F.col("t").asc_nulls_first(), "request_id")
    return ordered.mapInArrow(walk, "client long, request_id long")


def _walk_keys(batches, width: int, step, names: list[str], kinds):
    """Walk sorted rows (key, old, state.., row..): a key's held state stands first; out: its state after, and what steps emit."""
    import pyarrow as pa

    key, state, fresh, out = object(), None, False, []
    for batch in batches:
        for k, old, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if fresh:
                    out.append((key, *state, None))
                key, state, fresh = k, None, False
            if old:
                state = tuple(row[:width])
                continue
            before = len(out)
            state, fresh = step(state, row[width:], out), True
            if len(out) > before:
                out[-1] = (key, *(None,) * width, out[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)
            out = []
    if fresh:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, *state, None), kinds)], names)


def stream_keyed(rows: DataFrame, key: str, order: list[str], at: str, step, state: str, root: str, checkpoint: str, late: int = 0, emits: str | None = None):
    """Keep a small state per key of a stream in a log-structured table; returns the started query.

    ``rows``: key, order, time in seconds ``at``, and what ``step(state, row, out)`` needs:
    it gets the state or None and the row's other columns, returns the state after it and may
    append one long to ``out``.  A batch is one shuffle by key and one sort; a key costs its
    rows, no frame and no call to a state store of its own.  State whose ``ends`` is ``late``
    seconds behind the newest time of earlier batches is as good as gone.  What is emitted
    goes to the table ``emitted`` as (key, ``emits``).  A commit publishes both; a batch
    that was committed does nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    held = f"{key} long, {state}"
    fields = [f.name for f in StructType.fromDDL(state).fields]
    out = f"{held}, _emitted long"
    kinds = to_arrow_schema(StructType.fromDDL(out)).types
    inner = [c for c in rows.columns if c != key]

    def walk(batches):
        return _walk_keys(batches, len(fields), step, [key, *fields, "_emitted"], kinds)

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, content = ledger.read_commit(spark, root)
        if content.get("batch", -1) >= batch_id:
            return
        old = ledger.read_runs(spark, root, content, "state", held, [key])
        if "ends" in fields and content.get("newest") is not None:
            old = old.filter(F.col("ends") > content["newest"] - late)
        nothing = [F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in StructType.fromDDL(state).fields]
        new = batch.select(key, F.lit(False).alias("_old"), *nothing, *inner)
        both = new.unionByName(old.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_{c}") for c in fields)), allowMissingColumns=True)
        walked = both.repartition(key).sortWithinPartitions(key, F.desc("_old"), *order).mapInArrow(walk, out).persist()
        newest = batch.agg(F.max(at)).first()[0]
        seen = [t for t in (content.get("newest"), newest) if t is not None]
        after = content | {"batch": batch_id, "newest": max(seen, default=None)}
        after = ledger.add_run(after, "state", ledger.write_run(walked.filter("_emitted is null").drop("_emitted"), root, "state", version + 1, key))
        if emits:
            after = ledger.add_run(after, "emitted", ledger.write_run(walked.filter("_emitted is not null").select(key, F.col("_emitted").alias(emits)), root, "emitted", version + 1, key))
        ledger.commit(spark, root, version + 1, after)
        walked.unpersist()
        ledger.compact(spark, root, {"state": (held, [key])})

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_keyed(spark: SparkSession, root: str, table: str, fields: str) -> DataFrame:
    """``state`` (newest row of each key) or ``emitted`` (every row) of ``stream_keyed``."""
    content = ledger.read_commit(spark, root)[1]
    names = [f.split()[0] for f in fields.split(",")]
    if table == "state":
        return ledger.read_runs(spark, root, content, table, fields, names[:1])
    runs = content.get("tables", {}).get(table, [])
    return spark.read.schema(fields).parquet(*(f"{root}/{r['path']}" for r in runs)) if runs else ledger.nothing(spark, fields)


def stream_quota(log: DataFrame, root: str, checkpoint: str, limit: int = 120, seconds: int = 60):
    """The same on a stream whose batches come in order of time; state is one window per client."""
    width = seconds * 1_000_000

    def step(state, row, out):
        t, request, _ = row
        start, n = state or (None, 0)
        if start is None or t - start >= width:
            start, n = t, 0
        if n >= limit:
            out.append(request)
        return start, n + 1

    rows = log.select("client", F.unix_micros("ts").alias("t"), "request_id", F.unix_timestamp("ts").alias("at"))
    return stream_keyed(rows, "client", ["t", "request_id"], "at", step, "start long, n long", root, checkpoint, emits="request_id")


#: State of an account without scans is dropped after so many times the longest step.
EXPIRE_AFTER = 4
REFRESHED = "shown string, owner boolean, stage int, last long, ends long"
ZERO_KEYS = "stage int, first_at long, last_at long, due_at long, owner boolean, ends long"


def stream_refresh_state(scans: DataFrame, root: str, checkpoint: str, schedule: list[int], late: int = 86_400):
    """Per account: stage and next due time after each batch of scans in order of time.

    State: the last shown key set, whether the account is an owner, and its stage; it
    expires by event time, long after the last step of the ladder.
    """
    top, life = len(schedule) - 1, EXPIRE_AFTER * max(schedule)

    def step(state, row, out):
        at, _, ok, now = row
        shown, owner, stage, last, _ = state or ("", False, -1, 0, 0)
        owner = owner or bool(now)
        if owner and ok:
            stage = 0 if now != shown or stage < 0 else min(stage + 1, top)
            last = at
        return now, owner, stage, last, at + life

    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    now = F.when(ok & F.col("keys").isNotNull(), F.array_join(F.array_sort(F.array_distinct("keys")), ",")).otherwise("")
    rows = scans.select("account_id", F.unix_timestamp("observed_at").alias("at"), "scan_id", ok.alias("ok"), now.alias("now"))
    return stream_keyed(rows, "account_id", ["at", "scan_id"], "at", step, REFRESHED, root, checkpoint, late)


def read_refresh_state(spark: SparkSession, root: str, schedule: list[int]) -> DataFrame:
    rows = read_keyed(spark, root, "state", f"account_id long, {REFRESHED}").filter("stage >= 0")
    due = F.col("last") + F.get(F.array(*[F.lit(s).cast("long") for s in schedule]), F.col("stage")) + F.pmod("account_id", F.lit(900))
    return rows.select("account_id", "stage", due.alias("next_due_s"))


def stream_zero_keys(scans: DataFrame, root: str, checkpoint: str, ages: list[int], late: int = 86_400):
    """The zero-key ladder on a stream whose batches come in order of time.

    An account that has left the ladder has no stage (below 0).  An account with a key
    stays known, so that it stays out, until its state expires.
    """
    top, life = len(ages) - 1, EXPIRE_AFTER * max(ages)

    def step(state, row, out):
        at, _, source, has = row
        stage, first, last, due, owner, _ = state or (-1, 0, 0, 0, False, 0)
        if owner or has:
            owner, stage = True, -1
        elif source == "tail":
            stage, first, due = (0, at, at + ages[0]) if stage < 0 else (stage, first, due)
            last = at
        elif source == "onboarding" and stage >= top:
            stage = -1
        elif source == "onboarding" and stage >= 0:
            stage, last = stage + 1, at
            due = max(first + ages[stage], at + 300)
        return stage, first, last, due, owner, at + life

    rows = scans.select("account_id", F.unix_timestamp("observed_at").alias("at"), "scan_id", "source", (F.col("n_keys") > 0).alias("has"))
    return stream_keyed(rows, "account_id", ["at", "scan_id"], "at", step, ZERO_KEYS, root, checkpoint, late)


def read_zero_keys(spark: SparkSession, root: str) -> DataFrame:
    rows = read_keyed(spark, root, "state", f"account_id long, {ZERO_KEYS}")
    return rows.filter("stage >= 0").select("account_id", "stage", "first_at", "last_at", "due_at")
