"""What is due, what comes next, and what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 7 * 24 * 3600
# Order in which sources are served, by the class preferred.
SOURCE_ORDER = {
    "global": ["anomaly", "federation", "reconcile", "global", "tail", "onboarding", "priority"],
    "live": ["anomaly", "federation", "tail", "onboarding", "reconcile", "global", "priority"],
    "owner": ["anomaly", "federation", "priority", "reconcile", "global", "tail", "onboarding"],
}
CLASS_OF = {"tail": "live", "onboarding": "live", "priority": "owner"}
SHARES = {"global": 90, "live": 5, "owner": 5}


def route_failures(attempts: DataFrame) -> DataFrame:
    """``route``: shared faults (rate, gateway, auth) retry; others fall back from the third attempt."""
    shared = F.col("kind").isin("rate_limit", "gateway", "auth")
    return attempts.withColumn("route", F.when(shared, "retry").when(F.col("attempts") >= 3, "fallback").otherwise("retry"))


def backoff_seconds(attempts: Column, wait: Column | None = None) -> Column:
    """5 s doubling with each attempt, to 2**12 times and six hours; a given wait wins."""
    power = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(12))
    delay = F.least(5 * F.pow(F.lit(2.0), power), F.lit(6 * 3600.0)).cast("long")
    return delay if wait is None else F.when(wait > 0, wait.cast("long")).otherwise(delay)


def backoff(attempts: DataFrame) -> DataFrame:
    """``delay_s`` and ``next_at`` for rows (attempts, at, wait_s)."""
    rows = attempts.withColumn("delay_s", backoff_seconds(F.col("attempts"), F.col("wait_s")))
    return rows.withColumn("next_at", F.timestamp_seconds(F.unix_timestamp("at") + F.col("delay_s")))


def schedule_lookup(schedule: list[int], stage: Column) -> Column:
    """Delay of a stage: clamped to the ladder; an empty or non-positive step is a week."""
    if not schedule:
        return F.lit(WEEK).cast("long")
    at = F.get(F.array(*[F.lit(s).cast("long") for s in schedule]), F.greatest(F.lit(0), F.least(stage, F.lit(len(schedule) - 1))))
    return F.when(at > 0, at).otherwise(F.lit(WEEK).cast("long"))


def id_stagger(due_s: Column, account_id: Column) -> Column:
    """Due time in seconds, spread over a quarter of an hour by account."""
    return due_s + F.pmod(account_id, F.lit(900))


def due_not_inflight(source: DataFrame, inflight: DataFrame, now: Column, k: int) -> DataFrame:
    """Due rows without a row in flight in any class, oldest due first (top k)."""
    due = source.filter(F.col("due_at") <= now).join(inflight.select("account_id"), "account_id", "left_anti")
    return due.orderBy("due_at", "account_id").limit(k)


def _claim_order(preferred: str) -> list[Column]:
    order = F.array(*[F.lit(s) for s in SOURCE_ORDER.get(preferred, SOURCE_ORDER["global"])])
    return [F.when(F.col("status") == "retry", 0).otherwise(1), F.array_position(order, F.col("source")), F.col("due_at"), F.col("job_id")]


def batch_plan(jobs: DataFrame, preferred: str, k: int, now: Column) -> DataFrame:
    """The next k jobs: retries before pending, sources in the class's order, due time, id."""
    ready = jobs.filter(F.col("status").isin("retry", "pending") & (F.col("due_at") <= now))
    return ready.orderBy(*_claim_order(preferred)).limit(k)


def source_class() -> Column:
    out = F.lit("global")
    for source, kind in CLASS_OF.items():
        out = F.when(F.col("source") == source, kind).otherwise(out)
    return out


def batch_plan_weighted(jobs: DataFrame, k: int, now: Column) -> DataFrame:
    """k jobs by shares of the classes; a class's unused share goes to the others.

    Only the first k jobs of a class can be taken, so each class is cut to its top k
    (a bounded sort) before they are ranked together.
    """
    ready = jobs.filter(F.col("status").isin("retry", "pending") & (F.col("due_at") <= now)).withColumn("class", source_class())
    tops = None
    for kind, share in SHARES.items():
        quota = k * share // 100
        top = ready.filter(F.col("class") == kind).orderBy(*_claim_order(kind)).limit(k)
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*_claim_order(kind))))
        top = top.withColumn("borrowed", F.col("rank") > quota)
        tops = top if tops is None else tops.unionByName(top)
    return tops.orderBy("borrowed", *_claim_order("global")).limit(k).drop("rank")


def queue_breakdown(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_error(logs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest error that isn't null per key; null if there is none."""
    has = F.col("error").isNotNull()
    return logs.groupBy(*keys).agg(F.max_by("error", F.when(has, F.struct("at", "error"))).alias("latest_error"))


def job_health(*tables: DataFrame) -> DataFrame:
    """Retrying, running, attempts, oldest job and latest error over several job tables."""
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.unionByName(other)
    return rows.agg(
        F.count_if(F.col("status") == "retry").alias("retrying"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.coalesce(F.max("attempts"), F.lit(0)).alias("max_attempts"),
        F.min("at").alias("oldest_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "error"))).alias("latest_error"),
    )


def capped_count(df: DataFrame, due: str, k: int) -> DataFrame:
    """Exact count up to k, whether it is capped, and the oldest due; reads k + 1 rows' order."""
    first = df.select(due).orderBy(due).limit(k + 1)
    out = first.agg(F.count(F.lit(1)).alias("n"), F.min(due).alias("oldest"))
    return out.select(F.least("n", F.lit(k)).alias("n"), (F.col("n") > k).alias("capped"), "oldest")


def anomaly_ledger(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """Accounts whose failures no later success cleared; next attempt six hours after the last."""
    last_ok = successes.groupBy("account_id").agg(F.max("at").alias("ok_at"))
    rows = failures.join(last_ok, "account_id", "left").filter("ok_at is null or at > ok_at")
    newest = F.struct("at", "attempt_id")
    out = rows.groupBy("account_id").agg(
        F.max_by("kind", newest).alias("kind"),
        F.sum("attempts").alias("attempts"),
        F.min("at").alias("first_seen_at"),
        F.max("at").alias("last_seen_at"),
        F.max_by("error", newest).alias("last_error"),
    )
    return out.withColumn("next_attempt_at", F.col("last_seen_at") + F.expr("interval 6 hours"))


def stall_check(jobs: DataFrame, workers: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Per role group: stalled when work is due and the last success is too long ago."""
    due = jobs.groupBy("role").agg(F.count_if(F.col("due_at") <= now).alias("due"))
    seen = workers.groupBy("role").agg(F.max("last_success_at").alias("last_success_at"))
    rows = due.join(seen, "role", "left")
    late = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_success_at") > 60 * minutes, F.lit(True))
    return rows.withColumn("stalled", (F.col("due") > 0) & late)
