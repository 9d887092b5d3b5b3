"""Folds of the scan log into histories that forget nothing.

A scan is (account_id, observed_at, scan_id, status, keys, login, node_id).  Scans
of an account are ordered by (observed_at, scan_id); an inaccessible scan shows no
keys.  Every fold is one shuffle by account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schedule import id_stagger, schedule_lookup


def _by_account():
    return Window.partitionBy("account_id").orderBy("observed_at", "scan_id")


def _ok() -> Column:
    return F.col("status") == "ok"


def shown_keys() -> Column:
    """The keys a scan shows: none when the account was inaccessible."""
    return F.when(_ok(), F.coalesce("keys", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>"))


def ownership_history(scans: DataFrame) -> DataFrame:
    """Per (account, key): first, last seen, last verified, present, removed_at.

    A key is removed at the first later scan that lacks it; seeing it again clears
    that and keeps first_seen; pairs are never deleted.  ``last_verified_at`` is the
    account's last good scan.
    """
    order = F.struct("observed_at", "scan_id")
    rows = scans.withColumn("next_at", F.lead("observed_at").over(_by_account()))
    rows = rows.withColumn("verified_at", F.max(F.when(_ok(), F.col("observed_at"))).over(Window.partitionBy("account_id")))
    pairs = rows.withColumn("key", F.explode(F.array_distinct(shown_keys())))
    out = pairs.groupBy("account_id", "key").agg(
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
        F.max("verified_at").alias("last_verified_at"),
        F.max_by(F.struct("next_at"), order)["next_at"].alias("removed_at"),
    )
    return out.withColumn("present", F.col("removed_at").isNull())


def owners(scans: DataFrame) -> DataFrame:
    """One row per account that ever showed a key; login and node of its last good scan."""
    order = F.struct("observed_at", "scan_id")
    first = F.min(F.when(F.size(shown_keys()) > 0, F.col("observed_at")))
    out = scans.groupBy("account_id").agg(
        first.alias("first_seen_at"),
        F.max(F.when(_ok(), F.col("observed_at"))).alias("last_seen_at"),
        F.max_by(F.when(_ok(), F.col("login")), F.when(_ok(), order)).alias("login"),
        F.max_by(F.when(_ok(), F.col("node_id")), F.when(_ok(), order)).alias("node_id"),
        (F.max_by("status", order) == "inaccessible").alias("inaccessible"),
    )
    return out.filter(F.col("first_seen_at").isNotNull())


def login_history(observed: DataFrame) -> DataFrame:
    """Per (account, login): first, last seen and whether it is present.

    An observation clears every login of the account that differs from it without
    regard to case; "Alice" and "alice" are two rows and both stay present.
    """
    order = F.struct("observed_at", "tie")
    per = observed.groupBy("account_id", "login").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.max(order).alias("_last"))
    latest = F.max(F.struct("_last", "login")).over(Window.partitionBy("account_id"))["login"]
    return per.withColumn("present", F.lower("login") == F.lower(latest)).drop("_last")


def key_dimension(keys: DataFrame) -> DataFrame:
    """One row per fingerprint; the last writer wins for the other columns."""
    last = F.max_by(F.struct("text", "type", "canonical"), F.struct("observed_at", "canonical")).alias("k")
    return keys.groupBy("fingerprint").agg(F.min("observed_at").alias("first_seen_at"), last).select("fingerprint", "first_seen_at", "k.*")


def refresh_ladder(scans: DataFrame, schedule: list[int]) -> DataFrame:
    """Stage, last change and next due time of each owner's refresh schedule (seconds).

    A good scan whose key set differs from the scan before sets stage 0, any other
    good scan one more, up to the last; the next scan is due after the stage's delay
    plus an offset by account.  An inaccessible scan counts as an empty set for the
    comparison after it and moves nothing itself.
    """
    shown = F.array_sort(F.array_distinct(shown_keys()))
    rows = scans.withColumn("shown", shown).withColumn("before", F.lag("shown").over(_by_account()))
    upto = _by_account().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("owner", F.max(F.size("shown") > 0).over(upto)).filter("owner")
    empty = F.array().cast("array<long>")
    rows = rows.withColumn("changed", _ok() & ~F.coalesce("before", empty).eqNullSafe(F.col("shown")))
    rows = rows.filter(_ok())
    rows = rows.withColumn("change", F.sum(F.col("changed").cast("int")).over(upto))
    runs = rows.groupBy("account_id", "change").agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("last_changed_at"), F.max("observed_at").alias("last_scan_at"))
    last = runs.groupBy("account_id").agg(F.max_by(F.struct("n", "last_changed_at", "last_scan_at"), "change").alias("r")).select("account_id", "r.*")
    stage = F.least(F.col("n") - 1, F.lit(max(len(schedule) - 1, 0))).cast("int")
    due = F.timestamp_seconds(id_stagger(F.unix_timestamp("last_scan_at") + schedule_lookup(schedule, stage), F.col("account_id")))
    return last.select("account_id", stage.alias("stage"), "last_changed_at", "last_scan_at", due.alias("next_due_at"))


#: An account is looked at again after so many seconds at least.
AT_LEAST = 300


def _ladder_functions(batches, ages: list[int]):
    """Per account of a slice of sorted rows: where each state that may come in leads.

    States: 0 off the ladder, 1 and on its stages, last an owner.  Out: (account_id, begin,
    scan_id of the first row, moves), a move being (state, first, last, due, step, at); null
    registers keep what came in, and a step stands for the later of first + its age and
    ``at`` plus AT_LEAST where the first scan is the one that came in.
    """
    import pyarrow as pa

    top, owner = len(ages), len(ages) + 1
    names = ("state", "first_at", "last_at", "due_at", "step", "step_at")
    kind = pa.list_(pa.struct([(n, pa.int32() if n in ("state", "step") else pa.int64()) for n in names]))
    key, moves, begin, out, scan_kind = None, [], (), [], None

    def flush():
        if begin:
            out.append((key, *begin, [dict(zip(names, m)) for m in moves]))

    def taken():
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), scan_kind, kind))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["account_id", "begin", "scan_id", "moves"])

    for batch in batches:
        scan_kind = batch.schema.field("scan_id").type
        for account, at, scan, source, has in zip(*(batch.column(c).to_pylist() for c in ("account_id", "at", "scan_id", "source", "has"))):
            if not begin or key != account:
                flush()
                key, begin = account, (at, scan)
                moves = [[s, None, None, None, None, None] for s in range(owner + 1)]
            if has:
                moves = [[owner, None, None, None, None, None] for _ in moves]
            elif source == "tail":
                for m in moves:
                    if m[0] == 0:
                        m[:] = 1, at, at, at + ages[0], None, None
                    elif m[0] != owner:
                        m[2] = at
            elif source == "onboarding":
                for m in moves:
                    if m[0] == top:
                        m[:] = 0, None, None, None, None, None
                    elif 0 < m[0] < top:
                        m[0], m[2] = m[0] + 1, at
                        m[3:] = (None, m[0] - 1, at) if m[1] is None else (max(m[1] + ages[m[0] - 1], at + AT_LEAST), None, None)
        if out:
            yield taken()
    flush()
    if out:
        yield taken()


def zero_key_ladder(scans: DataFrame, ages: list[int]) -> DataFrame:
    """Accounts without keys that are looked at again at growing ages (seconds).

    ``scans``: (account_id, observed_at, scan_id, source, n_keys).  A first empty
    scan from "tail" starts stage 0; an empty "onboarding" scan goes one stage up,
    due at ``first + age``, but not within five minutes; past the last stage, or with
    any key, the account leaves, and an account that ever had a key stays out.

    A segmented scan: rows are range-partitioned by account and time, so an account with
    most rows is cut in as many slices as they need; each slice becomes a function from
    the state that comes in to the one that goes out, and an account's functions, at most
    one a task, are applied in order.
    """
    rows = scans.select(F.col("account_id").cast("long").alias("account_id"), F.unix_timestamp("observed_at").alias("at"), "scan_id", "source", (F.col("n_keys") > 0).alias("has"))
    rows = rows.filter("has or source in ('tail', 'onboarding')")
    tasks = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["account_id", "at", "scan_id"]
    move = "struct<state: int, first_at: long, last_at: long, due_at: long, step: int, step_at: long>"
    parts = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _ladder_functions(b, ages), f"account_id long, begin long, scan_id {dict(scans.dtypes)['scan_id']}, moves array<{move}>")
    log = parts.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("begin", "scan_id", "moves"))).alias("log"))
    delays = F.array(*[F.lit(a).cast("long") for a in ages])
    state = "struct<state: int, first_at: long, last_at: long, due_at: long>"
    off = F.struct(F.lit(0).alias("state"), *[F.lit(None).cast("long").alias(c) for c in ("first_at", "last_at", "due_at")]).cast(state)

    def step(s: Column, part: Column) -> Column:
        m = F.get(part["moves"], s["state"])
        first = F.coalesce(m["first_at"], s["first_at"])
        late = F.when(m["step"].isNotNull(), F.greatest(first + F.get(delays, m["step"]), m["step_at"] + AT_LEAST))
        return F.struct(m["state"].alias("state"), first.alias("first_at"), F.coalesce(m["last_at"], s["last_at"]).alias("last_at"), F.coalesce(m["due_at"], late, s["due_at"]).alias("due_at")).cast(state)

    out = log.select("account_id", F.aggregate("log", off, step).alias("s")).filter(F.col("s.state").between(1, len(ages)))
    return out.select("account_id", (F.col("s.state") - 1).alias("stage"), *[F.timestamp_seconds(f"s.{c}").alias(c) for c in ("first_at", "last_at", "due_at")])
