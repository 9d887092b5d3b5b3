"""Registered streaming queries: they replay ``events`` as a stream and return what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import fixtures as X
from ..session import shared_folder
from ..sources import ledger
from . import folds, membership, timers

AGES = [3_600, 86_400, 7 * 86_400, 28 * 86_400]
#: Window of the quota queries: long, as a user of the tables is seen a few times a day.
QUOTA_SECONDS = 86_400
REFRESH = [86_400, 3 * 86_400, 7 * 86_400, 14 * 86_400, 28 * 86_400]


class Replay:
    """A table as a stream: slices of time, oldest first, each landed when the stream has read those before."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str, slices: int, order: str):
        self.spark, self.schema, self.slices = spark, df.schema, slices
        self.staged, self.path = shared_folder(spark, f"{tag}-staged"), shared_folder(spark, tag)
        low, high = df.agg(F.min(F.unix_timestamp(order)), F.max(F.unix_timestamp(order))).first()
        place = F.floor((F.unix_timestamp(order) - (low or 0)) * slices / ((high or 0) - (low or 0) + 1))
        salt = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))
        df.withColumn("_slice", place).repartition("_slice", salt).write.partitionBy("_slice").parquet(self.staged)
        df.limit(0).write.parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def land(self):
        """Lands one slice after the other; the caller lets the stream run in between."""
        rows = self.spark.read.parquet(self.staged)
        for i in range(self.slices):
            rows.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(self.path)
            yield i


def _run(spark: SparkSession, replay: Replay, transform: Callable[[DataFrame], DataFrame], tag: str, mode: str) -> DataFrame:
    """Run a stream to its end; each batch is written once, the newest row wins where rows are updated."""
    out, state = shared_folder(spark, f"{tag}-out"), shared_folder(spark, f"{tag}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    for _ in replay.land():
        transform(replay.stream()).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/*")


def _keyed(spark: SparkSession, replay: Replay, start: Callable) -> str:
    """Run ``start(stream, root, checkpoint)`` slice by slice; returns the root of its tables."""
    root, state = shared_folder(spark, "keyed"), shared_folder(spark, "keyed-state")
    for _ in replay.land():
        start(replay.stream(), root, state).awaitTermination()
    return root


def _stream_history(spark: SparkSession, sf_dir: str, scans: DataFrame, tables: tuple[str, ...], name: str) -> DataFrame:
    replay = Replay(spark, scans, "scans", 3, "observed_at")
    root, state = shared_folder(spark, "ledger"), shared_folder(spark, "ledger-state")
    for _ in replay.land():
        folds.stream_history(replay.stream(), root, state, REFRESH, tables).awaitTermination()
    return X.seconds(folds.read_history(spark, root, name, REFRESH))


def r1_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_history(spark, sf_dir, X.scans(spark, sf_dir), ("pairs",), "pairs")


def r1_stream_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_history(spark, sf_dir, X.scans(spark, sf_dir), (), "owners")


def r1_stream_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_history(spark, sf_dir, X.scans(spark, sf_dir), ("logins",), "logins")


def r1_stream_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a scan is known by its account and week: event ids may come again
    weeks = X.weekly_scans(spark, sf_dir).withColumns({"scan_id": F.concat_ws("-", "account_id", F.date_format("observed_at", "yyyyMMdd")), "login": F.lit(None).cast("string"), "node_id": F.lit(None).cast("string"), "keys": F.col("keys").cast("array<long>")})
    return _stream_history(spark, sf_dir, weeks, (), "ladder")


def r2_stream_refresh_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = Replay(spark, X.weekly_scans(spark, sf_dir), "weeks", 3, "observed_at")
    root = _keyed(spark, scans, lambda s, root, state: folds.stream_refresh_state(s, root, state, REFRESH))
    return folds.read_refresh_state(spark, root, REFRESH)


def _due_rows(spark: SparkSession, scans: DataFrame, slices: int = 3) -> DataFrame:
    """Every row of the ladder with timers over a replay of scans."""
    with timers.rocks_db(spark):
        return _run(spark, Replay(spark, scans, "due", slices, "observed_at"), lambda s: timers.stream_due(s, REFRESH), "due", "update")


def r2_stream_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the ladder with due times, from a stream that also wakes accounts when they are due."""
    rows = _due_rows(spark, X.weekly_scans(spark, sf_dir)).filter("kind = 'scan'")
    return rows.groupBy("account_id").agg(F.max_by(F.struct("stage", "next_due_s"), "_batch").alias("r")).select("account_id", "r.stage", "r.next_due_s")


def r2_stream_zero_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = Replay(spark, X.ladder_scans(spark, sf_dir), "ladder", 3, "observed_at")
    root = _keyed(spark, scans, lambda s, root, state: folds.stream_zero_keys(s, root, state, AGES))
    return folds.read_zero_keys(spark, root)


def r3_stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.load(spark, sf_dir, "events").select("ts", "event_id")
    rows = _run(spark, Replay(spark, events, "rates", 3, "ts"), folds.stream_rates, "rates", "update")
    return X.seconds(folds.recent(rows.groupBy("minute").agg(F.max_by("n", "_batch").alias("n"))))


def r4_stream_highwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.load(spark, sf_dir, "events").select("ts", "event_type", "event_id")
    rows = _run(spark, Replay(spark, events, "marks", 3, "ts"), lambda s: folds.stream_highwater(s, "event_type", "event_id"), "marks", "update")
    return rows.groupBy("event_type").agg(F.max("event_id").alias("event_id"))


def r5_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.load(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    return _run(spark, Replay(spark, events, "dedupe", 3, "ts"), lambda s: folds.stream_dedupe(s, ["user_id", "event_type"]), "dedupe", "append").select("user_id", "event_type")


def r5_stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a horizon, against filters and a table of all keys."""
    events = X.load(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    replay, root, state = Replay(spark, events, "distinct", 3, "ts"), shared_folder(spark, "seen"), shared_folder(spark, "seen-state")
    for _ in replay.land():
        membership.stream_distinct(replay.stream(), ["user_id", "event_type"], root, state).awaitTermination()
    return membership.read_distinct(spark, root, "user_id long, event_type string")


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"))


def r6_quota_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.quota_violations(_access(spark, sf_dir), 3, QUOTA_SECONDS)


def r6_stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    replay = Replay(spark, _access(spark, sf_dir), "quota", 3, "ts")
    root = _keyed(spark, replay, lambda s, root, state: folds.stream_quota(s, root, state, 3, QUOTA_SECONDS))
    return folds.read_keyed(spark, root, "emitted", "client long, request_id long")


def s8_write_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the owner-key history twice and read the current version."""
    root = shared_folder(spark, "published")
    history = folds.history_state(X.scans(spark, sf_dir))
    for version in (1, 2):
        ledger.write_ledger(history.filter(F.lit(version == 2) | F.col("present")), root, "history", version)
    return X.seconds(ledger.read_ledger(spark, root, "history", folds.PAIRS))


QUERIES = {f.__name__: f for f in (r1_stream_history, r1_stream_owners, r1_stream_logins, r1_stream_ladder, r2_stream_due, r2_stream_zero_keys, r2_stream_refresh_state, r3_stream_rates, r4_stream_highwater, r5_stream_dedupe, r5_stream_distinct, r6_quota_violations, r6_stream_quota, s8_write_ledger)}


def _oracles() -> dict[str, str]:
    from ..plans.oracles import HISTORY, ORACLE_SQL, SCANS, WEEKS

    pairs = "SELECT account_id, key, epoch(first_seen_at)::BIGINT AS first_seen_at, epoch(last_seen_at)::BIGINT AS last_seen_at, present, epoch(removed_at)::BIGINT AS removed_at FROM history"
    quota = """WITH RECURSIVE e AS (SELECT user_id AS client, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      w AS (SELECT client, r, event_id, ts AS start, 1 AS n FROM e WHERE r = 1
        UNION ALL SELECT e.client, e.r, e.event_id, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN 1 ELSE w.n + 1 END
        FROM w JOIN e ON e.client = w.client AND e.r = w.r + 1)
      SELECT client, event_id AS request_id FROM w WHERE n > 3"""
    return {
        "r1_stream_history": "WITH " + HISTORY + "\n" + pairs,
        "s8_write_ledger": "WITH " + HISTORY + "\n" + pairs,
        "r2_stream_refresh_state": "WITH " + WEEKS + "\nSELECT account_id, stage, next_due_at AS next_due_s FROM ladder",
        "r2_stream_due": "WITH " + WEEKS + "\nSELECT account_id, stage, next_due_at AS next_due_s FROM ladder",
        "r1_stream_owners": ORACLE_SQL["h2_owners"],
        "r1_stream_ladder": ORACLE_SQL["h6_refresh_ladder"],
        "r1_stream_logins": "WITH " + SCANS + """, good AS (SELECT * FROM scans WHERE status = 'ok'), newest AS (SELECT account_id, max_by(login, observed_at) AS latest FROM good GROUP BY 1)
          SELECT account_id, login, epoch(min(observed_at))::BIGINT AS first_seen_at, epoch(max(observed_at))::BIGINT AS last_seen_at, lower(login) = lower(any_value(latest)) AS present
          FROM good JOIN newest USING (account_id) GROUP BY account_id, login""",
        "r2_stream_zero_keys": ORACLE_SQL["h7_zero_key_ladder"],
        "r3_stream_rates": """SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n FROM events
          WHERE date_trunc('minute', ts) > (SELECT max(date_trunc('minute', ts)) FROM events) - INTERVAL 7 DAY GROUP BY 1""",
        "r4_stream_highwater": "SELECT event_type, max(event_id) AS event_id FROM events GROUP BY 1",
        "r5_stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
        "r5_stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
        "r6_quota_violations": quota,
        "r6_stream_quota": quota,
    }


ORACLE_SQL = _oracles()
