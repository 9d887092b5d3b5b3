"""Registered queries: each operator over whole tables, with columns every engine can compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import coverage as C
from ..operators import history as H
from ..operators import lookup as L
from ..operators import progress as P
from ..operators import schedule as S
from ..operators import validation as V
from ..sources import folds, landed
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

NOW = "2024-01-20 12:00:00"
#: Distance of ids in the query over a sparse space.
SPREAD = 1_000_003
REFRESH = [86_400, 3 * 86_400, 7 * 86_400, 14 * 86_400, 28 * 86_400]
AGES = [3_600, 86_400, 7 * 86_400, 28 * 86_400]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: X.seconds(f(spark, sf_dir))
    return f


def _now(text: str = NOW):
    return F.lit(text).cast("timestamp")


# --- scans, sources, folds -------------------------------------------------


@query
def s1_accounts_from_listing(spark, d):
    return landed.accounts_from_listing(landed.read_listing(spark, X.landed_json(spark, X.listing_pages(spark, d), "listing")))


@query
def s2_scans_from_responses(spark, d):
    lines = X.key_lines(spark, d)
    node = F.struct(F.lit("User").alias("__typename"), F.concat(F.lit("U_"), "account_id").alias("id"), F.col("account_id").alias("databaseId"), F.concat(F.lit("login"), "account_id").alias("login"), F.col("observed_at").alias("createdAt"), F.struct(F.lit(1).alias("totalCount"), F.struct(F.lit(False).alias("hasNextPage"), F.lit(None).cast("string").alias("endCursor")).alias("pageInfo"), F.array(F.struct(F.col("raw").alias("key"), F.lit(None).cast("string").alias("fingerprint"))).alias("nodes")).alias("publicKeys"))
    resp = lines.select((F.col("account_id") % 50).alias("batch"), F.floor(F.col("account_id") / 50).alias("position"), F.col("account_id").alias("requested_id"), F.when(F.col("account_id") % 17 != 0, node).alias("node"))
    resp = landed.read_responses(spark, X.landed_json(spark, resp, "responses"))
    return landed.scans_from_responses(resp).select("batch", "position", "requested_id", "status", "account_id", "login", "total", F.coalesce(F.size("keys"), F.lit(-1)).alias("n_keys"))


@query
def s3_accounts_from_search(spark, d):
    pages = X.listing_pages(spark, d).select(F.col("page").alias("partition"), "page", F.col("objects").alias("items"))
    good, bad = landed.accounts_from_search(landed.read_search(spark, X.landed_json(spark, pages, "search")))
    return good.select("partition", "account_id", F.lit(False).alias("rejected")).unionByName(bad.select("partition", F.col("id").alias("account_id"), F.lit(True).alias("rejected")))


@query
def s4_append_new(spark, d):
    batch = X.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    have = X.load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return folds.append_new(have, batch, ["id"])


@query
def s5_keyed_latest(spark, d):
    return folds.keyed_latest(X.counters(spark, d), ["user_id"], ["at", "event_id"], ["event_id", "name"])


@query
def s6_keyed_max(spark, d):
    return folds.keyed_max(X.counters(spark, d), ["name"], "event_id")


@query
def s7_keyed_sum(spark, d):
    return folds.keyed_sum(X.counters(spark, d), ["name", "user_id"], ["requests"], ["gauge"], F.col("event_id"))


@query
def s9_users_export(spark, d):
    scans = X.scans(spark, d)
    out = L.users_export(H.owners(scans), H.ownership_history(scans))
    return out.select("account_id", "login", "url", "first_seen_at", "n_keys", F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + k["key"]).alias("key_sum"), F.size(F.filter("keys", lambda k: k["present"])).alias("n_present"))


# --- keys ------------------------------------------------------------------


@query
def p1_normalize_keys(spark, d):
    keys, _ = K.normalize_keys(X.key_lines(spark, d), "raw")
    return keys.select("account_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "text", "type", "canonical")


@query
def p2_key_rejects(spark, d):
    _, rejects = K.normalize_keys(X.key_lines(spark, d), "raw")
    return rejects.select("account_id", "reason")


@query
def p3_normalize_fingerprints(spark, d):
    keys, _ = K.normalize_keys(X.key_lines(spark, d), "raw")
    bare = F.substring("text", 8, 43)
    c = F.col("account_id")
    spelled = F.when(c % 4 == 0, F.concat(F.lit("sha256:"), bare)).when(c % 4 == 1, F.concat(bare, F.lit("="))).when(c % 4 == 2, F.concat(F.lit("  "), "canonical")).otherwise(F.concat(F.lit("x"), bare))
    return K.normalize_fingerprints(keys.select("account_id", spelled.alias("value")), "value").select("account_id", "normal")


def _snapshots(spark, d):
    """Three customers' keys as one response; some state a wrong fingerprint or none."""
    lines = K.parse_keys(X.key_lines(spark, d), "raw")
    c = F.col("account_id")
    stated = F.when(c % 19 == 0, F.concat(F.lit("SHA256:"), F.repeat(F.lit("A"), F.lit(43)))).when(c % 19 != 1, F.col("text"))
    scans = lines.groupBy(F.floor(c / 3).alias("batch")).agg(F.collect_list(F.struct("raw", stated.alias("stated"))).alias("keys"), F.min("observed_at").alias("created_at"))
    return scans.withColumn("position", F.lit(0)).withColumn("total", F.size("keys") + F.when(F.col("batch") % 7 == 0, 1).otherwise(0)).withColumn("has_more", F.col("batch") % 14 == 0).withColumn("cursor", F.when(F.col("batch") % 28 == 0, "c"))


@query
def p4_validate_snapshots(spark, d):
    return V.validate_key_snapshots(_snapshots(spark, d)).select("batch", "n", "reason")


@query
def p5_normalize_rest_snapshots(spark, d):
    return V.normalize_rest_snapshots(_snapshots(spark, d)).select("batch", "n", "reason")


@query
def p6_check_identity(spark, d):
    c = X.load(spark, d, "customer")
    asked = c.select((F.col("c_custkey") % 50).alias("batch"), F.floor(F.col("c_custkey") / 50).alias("position"), F.col("c_custkey").alias("account_id"), F.when(F.col("c_nationkey") > 5, F.concat(F.lit("U_"), "c_custkey")).alias("node_id"))
    got = asked.filter("account_id % 31 <> 0").select("batch", "position", (F.col("account_id") + F.when(F.col("account_id") % 23 == 0, 1).otherwise(0)).alias("account_id"), F.concat(F.lit("U_"), F.col("account_id") + F.when(F.col("account_id") % 29 == 0, 1).otherwise(0)).alias("node_id"))
    return V.check_identity(asked, got).select("account_id", "verdict")


@query
def p7_classify_actors(spark, d):
    c = X.load(spark, d, "customer")
    k = F.col("c_custkey")
    node = F.when(k % 3 == 0, F.concat(F.lit("U_"), k)).when(k % 3 == 1, F.base64(F.encode(F.concat(F.lit("04:User"), k), "utf-8"))).otherwise(F.concat(F.lit("B_"), k))
    return K.classify_actors(c.select(k.alias("account_id"), node.alias("node_id"), (k % 2).alias("n_keys")))


@query
def p8_profile_url(spark, d):
    return X.load(spark, d, "customer").select("c_custkey", L.profile_url("c_name").alias("url"))


@query
def p9_route_failures(spark, d):
    return S.route_failures(X.attempts(spark, d)).groupBy("kind", "attempts", "route").agg(F.count(F.lit(1)).alias("n"))


@query
def p10_backoff(spark, d):
    return S.backoff(X.attempts(spark, d)).select("job_id", "delay_s", "next_at")


@query
def p11_schedule_lookup(spark, d):
    return X.load(spark, d, "orders").select("o_orderkey", S.schedule_lookup([60, 0, 3600], (F.col("o_orderkey") % 7 - 2).cast("int")).alias("delay_s"))


@query
def p12_id_stagger(spark, d):
    return X.load(spark, d, "orders").select("o_orderkey", S.id_stagger(F.unix_timestamp("o_orderdate"), F.col("o_custkey")).alias("due_s"))


# --- histories -------------------------------------------------------------


@query
def h1_ownership_history(spark, d):
    return H.ownership_history(X.scans(spark, d))


@query
def h2_owners(spark, d):
    return H.owners(X.scans(spark, d))


@query
def h3_login_history(spark, d):
    return H.login_history(X.logins(spark, d))


@query
def h4_key_dimension(spark, d):
    keys, _ = K.normalize_keys(X.key_lines(spark, d), "raw")
    return H.key_dimension(keys).select(F.lower(F.hex("fingerprint")).alias("fingerprint"), "first_seen_at", "text", "canonical")


@query
def h5_inaccessible_fold(spark, d):
    scans = X.scans(spark, d)
    closed = scans.filter("status = 'inaccessible'").select("account_id", F.col("observed_at").alias("removed_at"))
    return H.ownership_history(scans).join(closed, ["account_id", "removed_at"]).groupBy("account_id").agg(F.count(F.lit(1)).alias("closed"))


@query
def h6_refresh_ladder(spark, d):
    return H.refresh_ladder(X.weekly_scans(spark, d), REFRESH)


@query
def h7_zero_key_ladder(spark, d):
    return H.zero_key_ladder(X.ladder_scans(spark, d), AGES)


@query
def h8_rolling_rates(spark, d):
    samples = P.rate_samples(X.totals(spark, d), _now("2024-01-31 00:00:00"), 365)
    out = P.rolling_rates(samples, 6)
    return out.select("run_id", "minute", F.round("processed_per_hour", 4).alias("processed_per_hour"), F.round("attempted_per_hour", 4).alias("attempted_per_hour"))


@query
def h9_rate_samples(spark, d):
    return P.rate_samples(X.totals(spark, d), _now())


@query
def h10_page_continuity(spark, d):
    ids = X.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    pages = ids.groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pages = pages.select(F.floor(F.col("page") / 20).alias("shard"), "page", (F.col("page") * 100 - 1).alias("since"), F.when(F.col("page") % 13 == 5, F.col("page") * 100 + 60).otherwise(F.lit(1 << 40)).alias("upper"), F.when(F.col("page") % 50 == 7, F.col("page") * 100 - 5).when(F.col("page") % 50 != 9, F.col("page") * 100 + 99).alias("next_since"), F.when(F.col("page") % 17 == 3, F.reverse("ids")).otherwise(F.col("ids")).alias("ids"))
    return V.audit_page_continuity(pages).select("shard", "page", "last_id", "verdict", "follows")


@query
def h11_search_stability(spark, d):
    remote, local = X.remote_local(spark, d)
    n = remote.groupBy("day").agg(F.count(F.lit(1)).alias("total"))
    pages = remote.join(n, "day").select(F.col("day").alias("partition"), (F.col("id") % 3).alias("page"), (F.col("total") + F.when(F.col("id") % 301 == 0, 1).otherwise(0)).alias("total"), (F.col("id") % 401 == 0).alias("incomplete"), F.col("id").alias("account_id"))
    counts = n.join(local.groupBy("day").agg(F.count(F.lit(1)).alias("l")), "day", "left").select(F.col("day").alias("partition"), F.col("total").alias("pre_count"), F.coalesce("l", F.lit(0)).alias("post_count"))
    return V.audit_search_stability(pages, counts)


@query
def h12_scan_two_pass(spark, d):
    return V.scan_two_pass(X.two_pass_pages(spark, d))


@query
def h13_id_islands(spark, d):
    return C.id_coverage_islands(X.shards(spark, d).filter("status = 'completed'").select("lower_id", "upper_id"))


@query
def x1_symmetric_difference(spark, d):
    li = X.load(spark, d, "lineitem")
    side = lambda p: li.filter(F.col("l_suppkey") % 2 == p).select("l_orderkey", "l_linenumber")
    return V.symmetric_difference(side(0), side(1))


@query
def x3_same_sets(spark, d):
    li = X.load(spark, d, "lineitem").select("l_orderkey")
    orders = X.load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    whole = V.same_sets(li, li.distinct()).withColumn("pair", F.lit("repeats"))
    return whole.unionByName(V.same_sets(li, orders).withColumn("pair", F.lit("orders")))


# --- lookups and joins -----------------------------------------------------


def _lookup(spark, d, form):
    """Every key any event names and some that nobody published, in several spellings."""
    scans = X.scans(spark, d)
    logins = H.login_history(scans.filter("status = 'ok'").select("account_id", "login", "observed_at", F.col("scan_id").alias("tie")))
    history = H.ownership_history(scans)
    numbers = X.load(spark, d, "events").select(X.key_number().alias("number")).distinct()
    numbers = numbers.union(numbers.filter("number % 50 = 0").select(F.col("number") + 1_000_000))
    return form(X.key_queries(numbers), X.printed_history(history), H.owners(scans), logins)


def _names(aliases):
    return F.array_join(F.transform(aliases, lambda a: a["login"]), "+")


@query
def j1_reverse_lookup(spark, d):
    return _lookup(spark, d, L.lookup_rows).select("query_id", "n_matches", "account_id", "login", "present", "first_seen_at", _names("aliases").alias("aliases"))


@query
def j1_lookup_lists(spark, d):
    item = lambda m: F.concat_ws(":", m["login"], m["present"], _names(m["aliases"]))
    return _lookup(spark, d, L.reverse_lookup).select("query_id", "n_matches", F.array_join(F.transform("matches", item), ",").alias("matches"))


@query
def j2_shared_keys(spark, d):
    return L.shared_keys(H.ownership_history(X.scans(spark, d)))


@query
def j3_alias_attach(spark, d):
    out = L.alias_list(H.login_history(X.logins(spark, d)))
    return out.select("account_id", F.array_join(F.transform("aliases", lambda a: a["login"]), ",").alias("aliases"))


@query
def j4_select_owner_results(spark, d):
    scans = X.scans(spark, d)
    results = scans.select("account_id", "scan_id", F.size(H.shown_keys()).alias("n_keys"))
    return V.select_owner_results(results, H.owners(scans).filter("account_id % 2 = 0")).select("account_id", "scan_id", "n_keys")


@query
def j5_due_not_inflight(spark, d):
    ladder = H.refresh_ladder(X.weekly_scans(spark, d), REFRESH).select("account_id", F.col("next_due_at").alias("due_at"))
    busy = X.attempts(spark, d).filter("status = 'running' and account_id % 3 = 0")
    return S.due_not_inflight(ladder, busy, _now("2025-01-01 00:00:00"), 50)


@query
def j6_calendar_gaps(spark, d):
    remote, local = X.remote_local(spark, d)
    seen = local.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return C.calendar_gaps(remote.select("day").distinct(), seen)


@query
def j7_stage_partition(spark, d):
    remote, local = X.remote_local(spark, d)
    return C.stage_partition(remote.select("day", "id"), local).filter("not resolved").select("day", "id")


@query
def j8_partition_resolution(spark, d):
    remote, local = X.remote_local(spark, d)
    return C.partition_resolution(C.stage_partition(remote.select("day", "id"), local))


def _time_staged(spark, d):
    """Orders in the bisected ranges of their dates; those with a line item are done."""
    orders = X.load(spark, d, "orders")
    leaves = C.bisect_partitions(orders, "o_orderdate", *_bounds(orders, F.unix_timestamp("o_orderdate")), 40)
    remote, local = X.remote_local(spark, d)
    return C.stage_time_partitions(remote.select("id", F.unix_timestamp("created_at").alias("second")), local, leaves)


@query
def j7_time_partitions(spark, d):
    return _time_staged(spark, d).filter("not resolved").select("lo", "hi", "id")


@query
def j8_time_resolution(spark, d):
    return C.partition_resolution(_time_staged(spark, d), "lo")


@query
def j9_run_generation(spark, d):
    jobs = X.load(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("run_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).alias("generation_id"))
    runs = X.runs(spark, d).select("run_id", (F.col("run_id") * 10).cast("long").alias("generation_id"))
    return P.run_generation_join(jobs, runs).groupBy("run_id", "generation_id").agg(F.count(F.lit(1)).alias("n"))


# --- aggregations ----------------------------------------------------------


def _bitmaps(spark, d):
    remote, local = X.remote_local(spark, d)
    marks = remote.select(F.lit("discovered").alias("mark"), "id").unionByName(local.select(F.lit("successful").alias("mark"), "id"))
    gone = remote.join(local.select("id"), "id", "left_anti").filter("id % 5 = 0").select(F.lit("inaccessible").alias("mark"), "id")
    return C.coverage_bitmap(marks.unionByName(gone))


@query
def a1_coverage_bitmap(spark, d):
    return _bitmaps(spark, d).groupBy("mark").agg(F.sum("n").alias("n"))


@query
def a2_coverage_summary(spark, d):
    return C.coverage_summary(_bitmaps(spark, d))


@query
def a2_missing_ids(spark, d):
    remote, local = X.remote_local(spark, d)
    return C.missing_ids(remote, local, remote.filter("id % 5 = 0"))


@query
def a2_missing_containers(spark, d):
    """The same ids out of compressed sets; ids are spread thinly by a factor first."""
    remote, local = X.remote_local(spark, d)
    spread = lambda df: C.id_containers(df.select((F.col("id") * SPREAD).alias("id")))
    missing = C.missing_in_sets(spread(remote), spread(local), spread(remote.filter("id % 5 = 0")))
    return C.ids_of(missing).select((F.col("id") / SPREAD).cast("long").alias("id"))


@query
def j7_stage_containers(spark, d):
    """Identities by whether the success set holds them, from compressed sets."""
    remote, local = (C.id_containers(df) for df in X.remote_local(spark, d))
    return C.ids_by_set(remote, local, "resolved")


@query
def a1_merge_bitmaps(spark, d):
    """Bitmaps of two sets of ids that overlap, merged."""
    ids = X.remote_local(spark, d)[0].select(F.lit("discovered").alias("mark"), "id")
    halves = C.coverage_bitmap(ids.filter("id % 3 < 2")).unionByName(C.coverage_bitmap(ids.filter("id % 3 > 0")))
    return C.merge_bitmaps(halves).groupBy("mark").agg(F.sum("n").alias("n"))


@query
def a3_coverage_by_day(spark, d):
    return C.coverage_by_day(X.remote_local(spark, d)[1])


@query
def a4_run_counters(spark, d):
    return P.run_counters(X.results(spark, d))


@query
def a5_first_attempts(spark, d):
    return P.first_attempts(X.results(spark, d), X.runs(spark, d).withColumn("enumerated", F.col("enumerated") - 5))


@query
def a6_queue_breakdown(spark, d):
    return S.queue_breakdown(X.attempts(spark, d))


@query
def a7_job_health(spark, d):
    jobs = X.attempts(spark, d)
    return S.job_health(jobs.filter("job_id % 2 = 0"), jobs.filter("job_id % 2 = 1"))


@query
def a8_capped_count(spark, d):
    return S.capped_count(X.attempts(spark, d), "due_at", 1000)


def _partitions(spark, d):
    remote, local = X.remote_local(spark, d)
    r = remote.groupBy("day").agg(F.count(F.lit(1)).alias("remote_count"), F.bool_or(F.col("id") % 997 == 0).alias("incomplete"))
    return C.reconcile_counts(r, local.groupBy("day").agg(F.count(F.lit(1)).alias("local_count")), cap=12)


@query
def a9_partition_rollup(spark, d):
    parts = _partitions(spark, d)
    return C.partition_rollup(parts.select("state", (F.col("remote_count") - F.col("local_count")).alias("missing")))


@query
def a10_range_progress(spark, d):
    out = P.range_progress(X.shards(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("ids_per_hour", "remaining_hours", "percent")})


@query
def a11_worker_rollup(spark, d):
    c = X.counters(spark, d)
    per = c.groupBy("name", (F.col("user_id") % 3).alias("role")).agg(F.count(F.lit(1)).alias("processed_users"), F.sum("requests").alias("requests"), F.min("at").alias("started_at"), F.max("at").alias("last_success_at"), F.max("at").alias("heartbeat_at"))
    per = per.withColumn("state", F.when(F.col("name") == "view", "stopped").otherwise("running"))
    out = P.worker_rollup(per, _now("2024-01-31 00:00:00"))
    return out.withColumn("users_per_hour", F.round("users_per_hour", 4))


@query
def a12_run_completion(spark, d):
    runs = X.runs(spark, d).withColumn("processed", F.col("enumerated") - F.col("run_id") % 2)
    busy = X.results(spark, d).filter("outcome = 'error' and account_id % 7 = 0").select("run_id")
    return P.run_completion(runs.withColumn("enumeration_complete", F.lit(True)), busy, busy.filter("run_id % 2 = 1")).select("run_id", "processed")


@query
def a13_index_totals(spark, d):
    scans = X.scans(spark, d)
    return L.index_totals(H.owners(scans), H.ownership_history(scans))


@query
def a14_anomaly_ledger(spark, d):
    log = X.attempts(spark, d)
    return S.anomaly_ledger(log.filter("event_type = 'error'"), log.filter("event_type = 'purchase'"))


@query
def a15_stall_check(spark, d):
    jobs = X.attempts(spark, d).withColumn("role", F.col("source"))
    ok = jobs.filter("event_type = 'purchase'").select("role", F.col("at").alias("last_success_at"))
    return S.stall_check(jobs, ok, _now())


@query
def a16_backlog(spark, d):
    return P.backlog(X.runs(spark, d)).select("run_id", "unattempted", "unsettled")


@query
def a16_class_depth(spark, d):
    return P.class_depth(X.attempts(spark, d))


# --- time, ids, forecasts --------------------------------------------------


@query
def t1_day_partitions(spark, d):
    return C.day_partitions(X.load(spark, d, "orders").agg(F.min("o_orderdate").alias("epoch"), F.expr("max(o_orderdate) + interval 6 hours").alias("cutoff")))


def _bounds(df, value):
    """Least and greatest value, two numbers; 0 and -1 of an empty table."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    return (0, -1) if low is None else (int(low), int(high))


@query
def t2_bisect_partitions(spark, d):
    events = X.load(spark, d, "events")
    return C.bisect_partitions(events, "ts", *_bounds(events, F.unix_timestamp("ts")), 100)


@query
def t2_bisect_unresolved(spark, d):
    orders = X.load(spark, d, "orders")
    return C.bisect_partitions(orders, "o_orderdate", *_bounds(orders, F.unix_timestamp("o_orderdate")), 5)


@query
def t3_reconcile_counts(spark, d):
    return _partitions(spark, d).select("day", "remote_count", "local_count", "state", "sampled")


@query
def t4_id_ranges(spark, d):
    ids = X.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    low, high = _bounds(ids, "id")
    ranges = C.id_ranges(spark, low, high, 64)
    held = C.range_density(ids, low, high, 64).select("range", F.col("users").alias("orders"))
    return ranges.join(held, "range")


@query
def t5_range_density(spark, d):
    ids = X.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    out = C.range_density(ids, *_bounds(ids, "id"), 64)
    return out.withColumn("density", F.round("density", 6)).withColumn("expected", C.expected_new(F.lit(1000), F.col("users"), F.col("upper_id") - F.col("lower_id") + 1))


@query
def t5_shard_density(spark, d):
    """Ids in uneven shards: unfinished ones are split where they stand, and each run's whole range is one more."""
    shards = X.shards(spark, d)
    cut = F.when(F.col("status") == "running", F.array(F.struct("lower_id", (F.col("next_id") - 1).alias("upper_id")), F.struct(F.col("next_id").alias("lower_id"), "upper_id"))).otherwise(F.array(F.struct("lower_id", "upper_id")))
    rows = shards.select("run_id", F.inline(cut)).filter("lower_id <= upper_id")
    rows = rows.unionByName(shards.groupBy("run_id").agg(F.min("lower_id").alias("lower_id"), F.max("upper_id").alias("upper_id")))
    ids = X.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return C.shard_density(ids, rows).select("run_id", "lower_id", "upper_id", "users", F.round("density", 6).alias("density"))


@query
def t6_pass_plan(spark, d):
    sweeps = X.shards(spark, d).groupBy("run_id").agg(F.min("lower_id").alias("lower_id"), F.max("upper_id").alias("upper_id")).withColumn("lower_id", F.when(F.col("run_id") == 0, 1).otherwise(F.col("lower_id")))
    sweeps = sweeps.withColumn("status", F.lit("completed")).withColumn("completed_at", _now("2024-01-01 00:00:00"))
    return P.pass_plan(sweeps, 10_000_000, _now(), 7 * 86_400)


@query
def t6_run_kind(spark, d):
    return X.runs(spark, d).select("run_id", *P.run_kind(F.col("enumeration_complete"), F.col("processed"), _now()))


def _progress(spark, d):
    li = X.load(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.groupBy(k.alias("sample")).agg(F.count(F.lit(1)).alias("items"), F.sum(n).cast("long").alias("sum")).select(
        "sample",
        (F.col("sample") % 5 == 0).alias("enumeration_complete"),
        (F.col("sample") * 1000).alias("enumerated"),
        (F.col("sample") * 990).alias("attempted"),
        (F.col("sample") * 900).alias("processed"),
        (F.col("items") * 17).alias("repair_jobs"),
        F.when(F.col("sample") % 7 == 0, F.lit(0)).otherwise(F.col("sum") * 5000).alias("remaining_ids"),
        F.when(F.col("sample") % 6 == 0, F.col("sum") * 10).otherwise(F.lit(0)).alias("repair_ids"),
        (F.col("sum") * 4000).alias("observed_ids"),
        (F.col("sum") * 3500).alias("observed_users"),
        F.lit(190_000_000).cast("long").alias("estimated_low"),
        F.lit(220_000_000).cast("long").alias("estimated_high"),
        F.when(F.col("sample") % 11 == 0, F.lit(0.0)).otherwise(F.lit(9400.0)).alias("rest_per_hour"),
        F.lit(9400.0).alias("key_per_hour"),
        F.when(F.col("sample") % 4 == 0, F.col("items") * 20_000.0).otherwise(F.lit(0.0)).alias("observed_per_hour"),
        F.lit(90.0).alias("list_users_per_request"),
        F.when(F.col("sample") % 3 == 0, F.lit(0.0)).otherwise(F.lit(5000.0)).alias("list_ids_per_request"),
        F.lit(100.0).alias("key_users_per_request"),
        F.lit(1.0).alias("repair_requests"),
        F.lit(0.95).alias("list_share"),
        F.lit(0.8).alias("key_share"),
        F.lit(100.0).alias("resource_users_per_request"),
        F.lit(0.0).alias("repair_fail_low"),
        F.lit(0.01).alias("repair_fail_high"),
        F.when(F.col("sample") % 2 == 0, F.col("items") * 100.0).otherwise(F.lit(0.0)).alias("rate_one_hour"),
        F.when(F.col("sample") % 3 == 0, F.lit(50.0)).otherwise(F.lit(0.0)).alias("rate_six_hours"),
        F.lit(0.0).alias("rate_run"),
        F.when(F.col("sample") % 5 == 0, F.lit(10.0)).otherwise(F.lit(0.0)).alias("rate_session"),
        F.lit(250.0).alias("list_users_per_hour"),
    )


@query
def t7_forecast(spark, d):
    out = P.forecast(_progress(spark, d))
    hours = ("scan_hours_low", "scan_hours_high", "hours_low", "hours_high", "users_per_hour")
    return out.select("sample", "basis", "preliminary", "future_low", "future_high", "remaining_low", "remaining_high", *[F.round(h, 6).alias(h) for h in hours])


@query
def t8_fallback_forecast(spark, d):
    out = P.fallback_forecast(_progress(spark, d))
    return out.select("sample", "rate_basis", "basis", "total_low", "total_high", "remaining_low", "remaining_high", F.round("hours_low", 6).alias("hours_low"), F.round("hours_high", 6).alias("hours_high"))


@query
def t9_stage_label(spark, d):
    return P.stage_label(X.runs(spark, d)).select("run_id", "stage")


@query
def t10_recovery_label(spark, d):
    jobs = X.attempts(spark, d).groupBy("account_id").agg(F.count_if(F.col("status") == "running").alias("active"), F.count_if(F.col("attempts") > 6).alias("stale"), F.count_if(F.col("status") == "retry").alias("retrying"))
    return jobs.select("account_id", P.recovery_label(F.col("active") % 4, F.col("stale") % 3, F.col("retrying") % 2).alias("label"))


@query
def t11_audit_verdict(spark, d):
    parts = _partitions(spark, d).select("day", (F.col("state") != "split").alias("complete"), F.col("remote_count").alias("searchable"), F.col("local_count").alias("enumerated"), (F.dayofmonth("day") > 3).alias("initial_complete"))
    return C.audit_verdict(parts).select("day", "gap", "verdict")


@query
def t12_status_report(spark, d):
    scans = X.scans(spark, d)
    jobs = S.job_health(X.attempts(spark, d)).drop("oldest_at")
    totals = L.index_totals(H.owners(scans), H.ownership_history(scans))
    forecast = _progress(spark, d).agg(F.count(F.lit(1)).alias("samples"))
    out = P.status_report(F.lit(0.5), totals=totals, jobs=jobs, coverage=C.coverage_summary(_bitmaps(spark, d)), forecast=forecast)
    return out.select("totals.*", "jobs.*", "coverage.*", "forecast.samples", F.get_json_object("json", "$.totals.associations").cast("long").alias("in_json"), F.get_json_object("json", "$.forecast").alias("left_out"))


# --- sorts, limits ---------------------------------------------------------


@query
def l1_keyset_page(spark, d):
    return L.keyset_page(H.owners(X.scans(spark, d)), 20, _now(), 25)


@query
def l2_batch_plan(spark, d):
    return S.batch_plan(X.attempts(spark, d), "live", 200, _now()).select("job_id", "source", "status")


@query
def l3_batch_plan_weighted(spark, d):
    return S.batch_plan_weighted(X.attempts(spark, d), 1000, _now()).select("job_id", "class", "borrowed")


@query
def l4_latest_error(spark, d):
    return S.latest_error(X.attempts(spark, d), ["account_id"])


@query
def l5_recent_runs(spark, d):
    return P.recent_runs(X.runs(spark, d), 3).select("run_id", "started_at")
