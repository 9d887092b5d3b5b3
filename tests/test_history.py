"""Closed forms against a replay, one scan after the other."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyfold.operators import history as H
from tallyfold.operators import progress as P
from tallyfold.operators import validation as V
from tallyfold.plans import fixtures, queries
from tallyfold.streaming import folds

from .conftest import DATA

SCHEMA = "account_id long, observed_at timestamp, scan_id string, status string, keys array<long>, login string, node_id string"


def random_scans(seed: int, accounts: int = 12, n: int = 9):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    out = []
    for a in range(accounts):
        for k in range(n):
            bad = r.random() < 0.2
            keys = sorted(r.sample(range(5), r.randint(0, 3)))
            out.append((a, start + timedelta(days=k, hours=a), f"{a}-{k}", "inaccessible" if bad else "ok", keys, r.choice(["Ann", "ann", "Bob"]), f"U_{a}"))
    return out


def replay(scans):
    pairs = {}
    for a, at, _, status, keys, *_ in sorted(scans, key=lambda s: (s[0], s[1], s[2])):
        shown = set(keys) if status == "ok" else set()
        for (b, key), p in pairs.items():
            if b == a and key not in shown and p[2] is None:
                p[2] = at
        for key in shown:
            p = pairs.setdefault((a, key), [at, at, None])
            p[1], p[2] = at, None
    return {k: tuple(v) for k, v in pairs.items()}


def collected(df):
    return {(r["account_id"], r["key"]): (r["first_seen_at"], r["last_seen_at"], r["removed_at"]) for r in df.collect()}


def test_history_equals_replay(spark):
    scans = random_scans(1)
    random.Random(2).shuffle(scans)
    assert collected(H.ownership_history(spark.createDataFrame(scans, SCHEMA))) == replay(scans)


def test_incremental_fold_equals_batch(spark):
    scans = sorted(random_scans(3), key=lambda s: s[1])
    cut = 60
    first, second = (spark.createDataFrame(part, SCHEMA) for part in (scans[:cut], scans[cut:]))
    state = folds.fold_history(folds.history_state(first), second)
    assert collected(state) == replay(scans)


def test_case_variants_stay_present(spark):
    rows = [(1, "Alice", datetime(2024, 1, 1), 0), (1, "alice", datetime(2024, 1, 2), 0), (1, "bob", datetime(2023, 1, 1), 0)]
    out = H.login_history(spark.createDataFrame(rows, "account_id long, login string, observed_at timestamp, tie int"))
    assert {r["login"]: r["present"] for r in out.collect()} == {"Alice": True, "alice": True, "bob": False}


def test_zero_key_ladder_equals_replay(spark):
    ages = queries.AGES
    rows = fixtures.ladder_scans(spark, DATA).collect()
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["account_id"], r["observed_at"], r["scan_id"])):
        a, at = r["account_id"], int(r["observed_at"].timestamp())
        if state.get(a) == "owner":
            continue
        if r["n_keys"] > 0:
            state[a] = "owner"
        elif r["source"] == "tail":
            stage, first, due = state[a] if a in state else (0, at, at + ages[0])
            state[a] = (stage, first, due)
        elif r["source"] == "onboarding" and a in state:
            stage, first, due = state[a]
            if stage >= len(ages) - 1:
                del state[a]
            else:
                state[a] = (stage + 1, first, max(first + ages[stage + 1], at + 300))
    out = {a: (s[0], s[2]) for a, s in state.items() if s != "owner"}
    got = H.zero_key_ladder(fixtures.ladder_scans(spark, DATA), ages)
    assert {r["account_id"]: (r["stage"], int(r["due_at"].timestamp())) for r in got.collect()} == out


def test_two_pass(spark):
    rows = [("a", 1, 1, 2), ("a", 1, 2, 2), ("a", 2, 2, 2), ("a", 2, 1, 2), ("b", 1, 1, 1), ("c", 1, 1, 1), ("c", 2, 2, 1), ("d", 1, 1, 2), ("d", 2, 1, 2)]
    got = V.scan_two_pass(spark.createDataFrame(rows, "scan_id string, pass int, key int, expected int")).collect()
    assert {r["scan_id"]: r["reason"] for r in got} == {"a": None, "b": "pass missing", "c": "passes differ", "d": "first pass unstable"}


def test_forecast_cases(spark):
    base = {c: 0 for c in "enumerated attempted processed repair_jobs remaining_ids repair_ids observed_ids observed_users estimated_low estimated_high".split()}
    rates = {"rest_per_hour": 100.0, "key_per_hour": 100.0, "observed_per_hour": 0.0, "list_users_per_request": 90.0, "list_ids_per_request": 0.0, "key_users_per_request": 100.0, "repair_requests": 1.0, "list_share": 0.0, "key_share": 0.0, "resource_users_per_request": 100.0, "repair_fail_low": 0.0, "repair_fail_high": 0.01}
    drained = base | rates | {"enumeration_complete": True, "enumerated": 1000, "attempted": 1000, "processed": 200, "repair_jobs": 800}
    first = base | rates | {"enumeration_complete": False, "enumerated": 27_918_819, "attempted": 27_918_819, "processed": 27_141_757, "repair_jobs": 769_639, "remaining_ids": 58_392_836, "observed_ids": 10_000_000, "observed_users": 8_928_904, "rest_per_hour": 9400.0, "key_per_hour": 9400.0, "list_share": 0.95, "key_share": 0.8}
    none = drained | {"key_per_hour": 0.0}
    names = list(drained)
    kinds = ", ".join(f"{n} {'boolean' if n == 'enumeration_complete' else 'double' if n in rates else 'long'}" for n in names)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in (drained, first, none)], kinds)
    got = {r["enumerated"]: r for r in P.forecast(df).collect()}
    assert len(got) == 2
    assert got[1000]["hours_low"] == 0.08 and got[1000]["future_low"] == 0
    big = got[27_918_819]
    assert 52_000_000 <= big["future_low"] <= 52_200_000
    assert 65 <= big["scan_hours_low"] <= 75 and big["scan_hours_low"] < big["scan_hours_high"] <= 95
    assert big["hours_low"] >= big["scan_hours_low"] and 700_000 <= big["users_per_hour"] <= 900_000


def test_weighted_batches(spark):
    """Shares of 90, 5 and 5 per cent, and a class's unused share lent to the others."""
    from tallyfold.operators import schedule as S

    def jobs(n_global, n_live, n_owner):
        kinds = [("global", n_global), ("tail", n_live), ("priority", n_owner)]
        rows = [(f"{s}{i:05d}", s, "pending", datetime(2024, 1, 1)) for s, n in kinds for i in range(n)]
        return spark.createDataFrame(rows, "job_id string, source string, status string, due_at timestamp")

    now = F.lit("2024-02-01").cast("timestamp")
    count = lambda df: {r["class"]: r["count"] for r in S.batch_plan_weighted(df, 1000, now).groupBy("class").count().collect()}
    assert count(jobs(1500, 1500, 1500)) == {"global": 900, "live": 50, "owner": 50}
    assert count(jobs(1500, 20, 0)) == {"global": 980, "live": 20}
    assert count(jobs(100, 400, 30)) == {"global": 100, "live": 400, "owner": 30}


def test_quota_windows_equal_replay(spark):
    draw = random.Random(2)
    rows = sorted((draw.randrange(3), datetime(2024, 1, 1) + timedelta(seconds=draw.randrange(4000)), i) for i in range(900))
    want, start, n, at = [], None, 0, None
    for client, ts, request in sorted(rows):
        if client != at or (ts - start).total_seconds() >= 60:
            at, start, n = client, ts, 0
        n += 1
        if n > 5:
            want.append((client, request))
    got = folds.quota_violations(spark.createDataFrame(rows, "client long, ts timestamp, request_id long"), 5, 60)
    assert sorted(map(tuple, got.collect())) == sorted(want)
