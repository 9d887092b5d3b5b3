"""Counters, rates, forecasts and labels of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_counters(results: DataFrame) -> DataFrame:
    """Per run: processed, zero, owner, inaccessible, error; each account counts once, its last result."""
    last = results.groupBy("run_id", "account_id").agg(F.max_by("outcome", F.struct("at", "outcome")).alias("outcome"))
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return last.groupBy("run_id").agg(F.count(F.lit(1)).alias("processed"), *map(count, ("zero", "owner", "inaccessible", "error")))


def first_attempts(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: accounts attempted, each once, never above the number enumerated."""
    firsts = attempts.groupBy("run_id", "account_id").agg(F.min("at").alias("at"))
    per = firsts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    rows = runs.select("run_id", "enumerated").join(per, "run_id", "left")
    return rows.select("run_id", "enumerated", F.least("enumerated", F.coalesce("n", F.lit(0))).alias("attempted"), "first_at")


def range_progress(shards: DataFrame) -> DataFrame:
    """Per run: positions processed and remaining, contiguous checkpoint, percent, states, rate.

    Shards: run_id, lower_id, upper_id, next_id (first not yet processed), status,
    error, at (hours since the run began).  Rates younger than an hour are preliminary.
    """
    processed = F.sum(F.least(F.col("next_id"), F.col("upper_id") + 1) - F.col("lower_id"))
    open_ = F.col("next_id") <= F.col("upper_id")
    has = F.col("error").isNotNull()
    out = shards.groupBy("run_id").agg(
        processed.alias("processed"),
        F.sum(F.col("upper_id") - F.col("lower_id") + 1).alias("total"),
        F.coalesce(F.min(F.when(open_, F.col("next_id"))) - 1, F.max("upper_id")).alias("checkpoint"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.max_by("error", F.when(has, F.struct("at", "error"))).alias("last_error"),
        F.max("at").alias("hours"),
    )
    out = out.withColumn("remaining", F.col("total") - F.col("processed")).withColumn("percent", F.round(100.0 * F.col("processed") / F.col("total"), 6))
    rate = F.when(F.col("hours") > 0, F.col("processed") / F.col("hours"))
    out = out.withColumn("ids_per_hour", rate).withColumn("remaining_hours", F.when(F.col("ids_per_hour") > 0, F.col("remaining") / F.col("ids_per_hour")))
    return out.withColumn("preliminary", F.col("hours") < 1)


def worker_rollup(updates: DataFrame, now: Column) -> DataFrame:
    """Per role: active and stale workers, users, requests and the session's rate per hour.

    A running worker is stale after ten minutes without heartbeat; stopped workers
    count for throughput only; the scheduler is no worker.
    """
    running = (F.col("state") == "running") & (F.col("name") != "scheduler")
    fresh = F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") <= 600
    out = updates.groupBy("role").agg(
        F.count_if(running & fresh).alias("active"),
        F.count_if(running & ~fresh).alias("stale"),
        F.sum("processed_users").alias("users"),
        F.sum("requests").alias("requests"),
        F.min("started_at").alias("started_at"),
        F.max("last_success_at").alias("last_success_at"),
    )
    hours = (F.unix_timestamp("last_success_at") - F.unix_timestamp("started_at")) / 3600.0
    return out.withColumn("users_per_hour", F.when(hours > 0, F.col("users") / hours).otherwise(F.lit(0.0)))


def run_completion(runs: DataFrame, overflow: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Runs that are complete: enumerated, all processed, nothing overflowing, no anomaly."""
    done = runs.filter(F.col("enumeration_complete") & (F.col("processed") >= F.col("enumerated")))
    return done.join(overflow.select("run_id"), "run_id", "left_anti").join(anomalies.select("run_id"), "run_id", "left_anti")


def backlog(runs: DataFrame) -> DataFrame:
    """Accounts of a run not yet attempted and not yet settled."""
    left = lambda c: F.greatest(F.lit(0), F.col("enumerated") - F.col(c))
    return runs.withColumn("unattempted", left("attempted")).withColumn("unsettled", left("processed"))


def class_depth(jobs: DataFrame) -> DataFrame:
    """Jobs waiting per class (global, live, owner)."""
    from .schedule import source_class

    return jobs.groupBy(source_class().alias("class")).agg(F.count(F.lit(1)).alias("depth"))


def run_generation_join(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs with the coverage generation they mark: their own, else their run's."""
    own = runs.select("run_id", F.col("generation_id").alias("_run_generation"))
    rows = jobs.join(own, "run_id", "left")
    return rows.withColumn("generation_id", F.coalesce("generation_id", "_run_generation")).drop("_run_generation")


def rate_samples(totals: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The last totals of each minute (at, processed, attempted), kept for some days."""
    minute = F.date_trunc("minute", "at")
    last = F.max_by(F.struct("processed", "attempted"), F.struct("at", "processed")).alias("s")
    kept = totals.filter(F.col("at") > now - F.expr(f"interval {days} days"))
    return kept.groupBy("run_id", minute.alias("minute")).agg(last).select("run_id", "minute", "s.*")


def rolling_rates(samples: DataFrame, hours: int) -> DataFrame:
    """Per sample: processed and attempted per hour over the trailing window; 0 when empty.

    A run's samples are cut in blocks of the window's length, and each block also holds
    the one before it, so a window never looks outside and a long run spreads over tasks.
    """
    seconds, span = F.unix_timestamp("minute"), 3600 * hours
    block = F.floor(seconds / span)
    copies = F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")), F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")))
    rows = samples.select("*", F.inline(copies))
    w = Window.partitionBy("run_id", "_block").orderBy(seconds).rangeBetween(-span, 0)
    rows = rows.withColumn("_first", F.first(F.struct(seconds.alias("at"), "processed", "attempted")).over(w)).filter("_own")
    elapsed = (seconds - F.col("_first.at")) / 3600.0
    rate = lambda c: F.when(elapsed > 0, (F.col(c) - F.col(f"_first.{c}")) / elapsed).otherwise(F.lit(0.0))
    return rows.withColumn("processed_per_hour", rate("processed")).withColumn("attempted_per_hour", rate("attempted")).drop("_first", "_block", "_own")


def pass_plan(runs: DataFrame, highwater: int, now: Column, interval_s: int) -> DataFrame:
    """The next sweep: initial, tail, reconcile or none, with its range."""
    full = F.when((F.col("lower_id") == 1) & (F.col("status") == "completed"), F.col("completed_at"))
    state = runs.agg(F.coalesce(F.max("upper_id"), F.lit(0)).alias("top"), F.max(full).alias("last_full"))
    old = F.col("last_full").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_full") >= interval_s)
    kind = F.when(F.col("top") == 0, "initial").when(F.col("top") < highwater, "tail").when(old, "reconcile").otherwise("none")
    rows = state.withColumn("kind", kind)
    lower = F.when(F.col("kind") == "tail", F.col("top") + 1).when(F.col("kind") != "none", F.lit(1))
    return rows.select("kind", lower.cast("long").alias("lower_id"), F.when(F.col("kind") != "none", F.lit(highwater)).cast("long").alias("upper_id"))


def run_kind(initial_complete: Column, highwater: Column, now: Column) -> list[Column]:
    """Kind, id cutoff and settled time of the next run: all but the first are global."""
    kind = F.when(initial_complete, "global").otherwise("initial").alias("kind")
    return [kind, F.when(initial_complete, highwater).alias("cutoff_id"), F.when(initial_complete, F.date_trunc("second", now - F.expr("interval 48 hours"))).alias("settled_cutoff")]


def _bounded(name: str, low: float, high: float, default: float) -> Column:
    value = F.col(name)
    return F.when(value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf")), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


#: Share of new accounts that need a repair, and the late margin.
REPAIR_LOW, REPAIR_HIGH, LATE = 0.001, 0.005, 1.10


def forecast(progress: DataFrame) -> DataFrame:
    """Early and late bounds of two lanes' remaining hours for every progress row.

    The listing lane walks id positions, the key lane looks accounts up; each has its
    requests per hour.  Work known now is the backlog; work to come is bounded by what
    id ranges are left and how dense they have been, or by a planning range.  The later
    lane decides; the late side carries a tenth more.  Rows without a capacity give
    no forecast.
    """
    c = F.col
    rows = progress.filter((c("rest_per_hour") > 0) & (c("key_per_hour") > 0))
    # Least, greatest and default of each rate.
    rates = {
        "users_per_list": _bounded("list_users_per_request", 1, 100, 90),
        "ids_per_list": _bounded("list_ids_per_request", 1, 1000, 100),
        "users_per_key": _bounded("key_users_per_request", 1, 250, 100),
        "requests_per_repair": _bounded("repair_requests", 1, 10, 1),
        "list_share": _bounded("list_share", 0.05, 1, 0.5),
        "key_share": _bounded("key_share", 0.05, 1, 0.8),
        "users_per_resource": _bounded("resource_users_per_request", 1, 100, 100),
        "fail_low": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("repair_fail_low"))),
    }
    rows = rows.withColumns({f"_{k}": v for k, v in rates.items()})
    rows = rows.withColumn("_fail_high", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest("repair_fail_high", "_fail_low"))))
    capacity = c("key_per_hour") * c("_key_share") * c("_users_per_key")
    rows = rows.withColumn("_capacity", F.when(c("observed_per_hour") > 0, F.least(capacity, c("observed_per_hour"))).otherwise(capacity))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("backlog", F.greatest(zero, c("enumerated") - c("processed")))
    rows = rows.withColumn("_plain", F.greatest(zero, c("backlog") - c("repair_jobs")))
    dense = (c("remaining_ids") > 0) & (c("observed_ids") > 0)
    case = F.when(c("enumeration_complete"), "exact").when(c("repair_ids") > 0, "replay").when(dense, "density").otherwise("envelope")
    rows = rows.withColumn("basis", case)
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("observed_users") / c("observed_ids")))
    planned = F.greatest(zero, c("estimated_low") - c("enumerated"))
    low = F.when(c("basis") == "exact", zero).when(c("basis") == "density", F.ceil(c("remaining_ids") * density)).otherwise(planned)
    rows = rows.withColumn("future_low", low.cast("long"))
    high = F.when(c("basis") == "exact", zero).when(c("basis") == "density", c("remaining_ids")).otherwise(F.greatest("future_low", c("estimated_high") - c("enumerated")))
    rows = rows.withColumn("future_high", high.cast("long"))
    few = c("attempted") < 1_000_000
    rows = rows.withColumn("preliminary", F.when(c("basis") == "exact", few).when(c("basis") == "density", few | (c("observed_ids") < 1_000_000)).otherwise(F.lit(True)))
    lists = c("remaining_ids") / c("_ids_per_list")
    for side, margin, ratio, fail in (("low", 1.0, REPAIR_LOW, "_fail_low"), ("high", LATE, REPAIR_HIGH, "_fail_high")):
        future = c(f"future_{side}")
        scan = F.greatest(lists * margin / (c("rest_per_hour") * c("_list_share")), (c("_plain") + future) * margin / c("_capacity"))
        rest = (c("repair_jobs") * c(fail) * c("_requests_per_repair") + lists + future * ratio * c(fail) * c("_requests_per_repair")) * margin
        keys = (c("_plain") / c("_users_per_key") + c("repair_jobs") / c("_users_per_resource") + future / c("_users_per_key") + future * ratio / c("_users_per_resource")) * margin
        rows = rows.withColumns({f"scan_hours_{side}": scan, f"rest_hours_{side}": rest / c("rest_per_hour"), f"key_hours_{side}": keys / c("key_per_hour")})
        rows = rows.withColumn(f"hours_{side}", F.greatest(f"rest_hours_{side}", f"key_hours_{side}", f"scan_hours_{side}"))
        rows = rows.withColumn(f"total_{side}", c("enumerated") + future).withColumn(f"remaining_{side}", c("backlog") + future)
    rows = rows.withColumn("users_per_hour", F.when(c("hours_low") > 0, c("remaining_low") / c("hours_low")).otherwise(F.lit(0.0)))
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def fallback_forecast(progress: DataFrame) -> DataFrame:
    """Hours left from one observed rate, for rows whose lane capacities are unknown.

    The rate is the first positive of: the last hour's, six hours', the run's, the
    session's.  No row without one.
    """
    c = F.col
    rate, basis = F.lit(0.0), F.lit(None).cast("string")
    for name in ("session", "run", "six_hours", "one_hour"):
        rate = F.when(c(f"rate_{name}") > 0, c(f"rate_{name}")).otherwise(rate)
        basis = F.when(c(f"rate_{name}") > 0, name).otherwise(basis)
    rows = progress.withColumn("rate", rate).withColumn("rate_basis", basis).filter("rate > 0")
    zero = F.lit(0).cast("long")
    left = F.greatest(zero, c("enumerated") - c("processed"))
    exact = c("enumeration_complete") & (c("enumerated") > 0)
    dense = (c("remaining_ids") > 0) & (c("observed_ids") > 0)
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("observed_users") / c("observed_ids")))
    rows = rows.withColumn("basis", F.when(exact, "exact").when(dense, "density").otherwise("envelope"))
    rows = rows.withColumn("future", F.when(c("basis") == "density", F.ceil(c("remaining_ids") * density)).otherwise(zero).cast("long"))
    for side in ("low", "high"):
        more = c("future") if side == "low" else c("remaining_ids")
        total = F.when(c("basis") == "exact", c("enumerated")).when(c("basis") == "density", c("enumerated") + more).otherwise(c(f"estimated_{side}"))
        remaining = F.when(c("basis") == "exact", left).when(c("basis") == "density", left + more).otherwise(F.greatest(zero, c(f"estimated_{side}") - c("processed")))
        hours = F.col(f"remaining_{side}") / c("rate")
        listed = F.when((c("basis") == "density") & (c("list_users_per_hour") > 0), F.greatest(hours, more / c("list_users_per_hour"))).otherwise(hours)
        rows = rows.withColumn(f"total_{side}", total).withColumn(f"remaining_{side}", remaining).withColumn(f"hours_{side}", listed)
    return rows.drop("future")


def stage_label(progress: DataFrame) -> DataFrame:
    """Stage of a run; the first that holds."""
    c = F.col
    rows = backlog(progress)
    label = (
        F.when(c("enumeration_complete") & (c("unsettled") == 0), "complete")
        .when(~c("enumeration_complete") & (c("repair_jobs") > 0), "discovery_and_resource_repair")
        .when(c("unattempted") > 0, "graphql_indexing")
        .when(c("unsettled") > 0, "resource_repair_drain")
        .otherwise("enumerating")
    )
    return rows.withColumn("stage", label)


def recovery_label(active: Column, stale: Column, retrying: Column) -> Column:
    return F.when(active == 0, "offline").when(stale > 0, "stalled").when(retrying > 0, "recovering").otherwise("healthy")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def status_report(young_hours: Column | None = None, **parts: DataFrame) -> DataFrame:
    """One row of one-row tables as nested structs, and the whole as JSON.

    With ``young_hours`` below 1 the compact form leaves the forecast out.
    """
    out = None
    for name, part in parts.items():
        row = part.select(F.struct(*part.columns).alias(name))
        out = row if out is None else out.crossJoin(row)
    compact = [c for c in out.columns if c != "forecast"]
    small = F.to_json(F.struct(*compact))
    whole = F.to_json(F.struct(*out.columns))
    return out.select(*out.columns, F.when(young_hours < 1, small).otherwise(whole).alias("json") if young_hours is not None else whole.alias("json"))
