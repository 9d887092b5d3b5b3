"""Ledger inputs made from the plain tables, so that every operator runs at their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import multiples
from ..functions.keys import fingerprint_text
from ..session import shared_folder, tasks_for

#: Rows of one task where several operators hold them in memory at once.
ROWS_PER_TASK = 500_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t.startswith("timestamp")})


def seconds(df: DataFrame) -> DataFrame:
    """Timestamps as whole seconds, days as text: equal in every engine."""
    kinds = dict(df.dtypes)
    change = {c: F.unix_timestamp(c) for c, t in kinds.items() if t.startswith("timestamp")}
    change |= {c: F.date_format(c, "yyyy-MM-dd") for c, t in kinds.items() if t == "date"}
    return df.withColumns(change) if change else df


def key_number() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("long")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per user and day of events; two errors in a day make it inaccessible."""
    day = F.date_trunc("day", "ts")
    out = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account_id"), day.alias("observed_at")).agg(
        F.when(F.count_if(F.col("event_type") == "error") > 1, "inaccessible").otherwise("ok").alias("status"),
        F.array_sort(F.collect_set(key_number())).alias("keys"),
    )
    out = out.withColumn("scan_id", F.concat_ws("-", "account_id", F.date_format("observed_at", "yyyyMMdd")))
    login = F.concat(F.lit("user"), F.col("account_id"), F.when(F.dayofmonth("observed_at") >= 20, "b").otherwise(""))
    return out.withColumn("login", login).withColumn("node_id", F.concat(F.lit("U_"), F.col("account_id")))


def weekly_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per user and week; its keys are numbers of the event types; some are inaccessible."""
    kind = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account_id"), F.date_trunc("week", "ts").alias("observed_at"))
    rows = rows.agg(F.array_sort(F.collect_set(kind)).alias("keys"), F.max("event_id").alias("scan_id"))
    return rows.withColumn("status", F.when(F.col("scan_id") % 7 == 3, "inaccessible").otherwise("ok"))


def _blob(key: Column) -> Column:
    """An ed25519 blob of a key number as hexadecimal digits."""
    return F.concat(_named("ssh-ed25519"), _field(F.sha2(F.concat(F.lit("k"), key.cast("string")), 256), 32))


def printed_history(history: DataFrame) -> DataFrame:
    """A history whose keys are fingerprint texts instead of numbers."""
    return history.withColumn("number", F.col("key")).withColumn("key", fingerprint_text(F.unhex(F.sha2(F.unhex(_blob(F.col("key"))), 256))))


def key_queries(numbers: DataFrame) -> DataFrame:
    """(query_id, value) for key numbers: fingerprints in several spellings, key lines, and some that are none."""
    k = F.col("number")
    bare = F.substring(fingerprint_text(F.unhex(F.sha2(F.unhex(_blob(k)), 256))), 8, 43)
    line = F.concat(F.lit("ssh-ed25519 "), F.regexp_replace(F.base64(F.unhex(_blob(k))), "[\r\n]", ""), F.lit(" me"))
    value = F.when(k % 23 == 0, F.concat(F.lit("x"), bare)).when(k % 4 == 0, F.concat(F.lit("sha256:"), bare)).when(k % 4 == 1, F.concat(F.lit(" SHA256:"), bare, F.lit("= "))).when(k % 4 == 2, bare).otherwise(line)
    return numbers.select(k.alias("query_id"), value.alias("value"))


def ladder_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup: an empty tail scan, view: an empty onboarding scan; every 29th purchase shows a key."""
    rows = load(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "signup", "tail").when(F.col("event_type") == "view", "onboarding").otherwise("global")
    return rows.select(F.col("user_id").alias("account_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("scan_id"), source.alias("source"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 29 == 0)).cast("int").alias("n_keys"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as the logins of customers; every tenth order in capitals."""
    rows = load(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 10 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    return rows.select(F.col("o_custkey").alias("account_id"), name.alias("login"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("tie"))


#: Some points of the curve P-256.
POINTS = multiples("nistp256", 8)


def _field(digits: Column, size: int) -> Column:
    """A length-prefixed field of ``size`` bytes as hexadecimal digits."""
    return F.concat(F.lit(f"{size:08X}"), digits)


def _named(text: str) -> Column:
    return F.lit(f"{len(text):08X}{text.encode().hex()}")


def key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key value per customer: twelve kinds, good and broken, some shared, some no key at all."""
    c, seed, kind, own = F.col("c_custkey"), F.col("seed"), F.col("seed") % 12, F.col("own")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.when(c % 13 == 0, c - 1).otherwise(c).alias("seed"))
    digits = lambda letter: F.sha2(F.concat(F.lit(letter), seed.cast("string")), 256)
    rows = rows.select("*", F.inline(F.array(F.struct(digits("k").alias("own"), digits("l").alias("more")))))
    edwards = F.concat(_named("ssh-ed25519"), _field(own, 32))
    rsa = F.concat(_named("ssh-rsa"), F.lit("00000003010001"), _field(F.concat(F.lit("00C5"), own, "more"), 66))
    # every other point is on the curve
    true = F.get(F.array(*[F.lit(p.hex().upper()) for p in POINTS]), (F.floor(seed / 24) % len(POINTS)).cast("int"))
    point = _field(F.when(F.floor(seed / 12) % 2 == 0, true).otherwise(F.concat(F.lit("04"), own, "more")), 65)
    rest = "0" * 15 + "7" + "00000001" + "00000002" + b"id".hex() + "0" * 8 + "0" * 32 + "0" * 24 + "00000001AB" + "00000001CD"
    signed = F.concat(_named("ssh-ed25519-cert-v01@openssh.com"), F.lit("000000016E"), _field(own, 32), F.lit(rest))
    curve = lambda name: F.concat(_named("ecdsa-sha2-nistp256"), _named(name), point)
    kinds = [edwards] * 4 + [rsa, rsa, curve("nistp256"), signed, curve("nistp384"), F.concat(_named("ssh-ed25519"), _named("abc")), F.substring(edwards, 1, 98), edwards]
    blob = F.when(c % 55 == 0, F.concat(_named("ssh-foo"), _field(own, 32))).otherwise(F.get(F.array(*kinds), kind.cast("int")))
    rows = rows.select("*", F.inline(F.array(F.struct(F.regexp_replace(F.base64(F.unhex(blob)), "[\r\n]", "").alias("coded")))))
    coded = F.when(c % 35 == 0, F.concat(F.lit("*"), "coded")).when(kind == 5, F.rtrim("coded", F.lit("="))).otherwise(F.col("coded"))
    before = F.when(kind == 2, 'no-pty,command="a \\"b c\\" d" ').when(kind == 3, "# note\n\n").otherwise("")
    line = F.concat(F.lit("key "), coded, F.when(c % 5 == 0, F.concat(F.lit(" user"), c)).otherwise(""), F.lit("\n"))
    raw = F.concat(before, F.repeat(line, F.when(kind == 11, 2).otherwise(1)))
    return rows.select(c.alias("account_id"), raw.alias("raw"), F.timestamp_seconds(c % 1000).alias("observed_at"))


def landed_json(spark: SparkSession, df: DataFrame, tag: str) -> str:
    """Rows as files of JSON lines, and one line that is cut off; returns the folder."""
    path = shared_folder(spark, tag)
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.union(spark.range(1).select(F.lit('{"page": 1, "batch": 1, "partition": 1, "node": {"id": ').alias("value"))).write.text(path)
    return path


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listing pages of a hundred ids; nation 0 are no users."""
    c = load(spark, sf_dir, "customer")
    item = F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("U_"), F.col("c_custkey")).alias("node_id"), F.col("c_name").alias("login"), F.when(F.col("c_nationkey") == 0, "Organization").otherwise("User").alias("type"))
    return c.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("objects"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an attempt log: errors fail, purchases succeed, others wait."""
    e = load(spark, sf_dir, "events")
    number = F.col("event_id") % 7 + 1
    kind = F.get(F.array(*map(F.lit, ("rate_limit", "gateway", "auth", "timeout", "shape"))), (F.col("event_id") % 5).cast("int"))
    status = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "purchase", "running").otherwise("pending")
    source = F.get(F.array(*map(F.lit, ("global", "tail", "onboarding", "priority", "reconcile", "anomaly", "federation"))), (F.col("event_id") % 7).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), F.col("event_id").alias("attempt_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("at"), F.col("ts").alias("due_at"), number.cast("int").alias("attempts"), kind.alias("kind"), status.alias("status"), source.alias("source"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id") % 11)).alias("error"), (F.when(F.col("event_id") % 4 == 0, F.lit(30))).alias("wait_s"), F.col("event_type"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as worker updates: type is the worker, user the key."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("name"), F.col("user_id"), F.col("ts").alias("at"), F.col("event_id"), F.lit(1).alias("requests"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("gauge"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a run: every event attempts, purchases process; four runs."""
    e = load(spark, sf_dir, "events").select(F.col("ts").alias("at"), "event_id", (F.col("user_id") % 4).alias("run_id"))
    return e.withColumn("attempted", F.col("event_id") + 1).withColumn("processed", F.floor(F.col("event_id") / 2))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of yearly runs."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    o = o.join(li, "o_orderkey", "left")
    outcome = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 97 == 0), "error").when(F.col("o_orderkey") % 89 == 0, "inaccessible").when(F.col("has").isNull(), "zero").otherwise("owner")
    return o.select(F.year("o_orderdate").alias("run_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("at"), outcome.alias("outcome"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per year of orders, with its counts."""
    o = load(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    return o.groupBy(y.alias("run_id")).agg(
        F.count_distinct("o_custkey").alias("enumerated"),
        F.count_distinct(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).alias("attempted"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("processed"),
        F.count_if(F.col("o_orderkey") % 211 == 0).alias("repair_jobs"),
        F.min("o_orderdate").alias("started_at"),
        (F.max("o_orderkey") % 2 == 0).alias("enumeration_complete"),
    )


def shards(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Equal ranges of order keys with their number of orders; some unfinished."""
    o = load(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("top")).withColumn("total", F.col("top") + 1)
    rows = spark.range(n).crossJoin(o)
    lower, upper = F.floor(F.col("total") * F.col("id") / n), F.floor(F.col("total") * (F.col("id") + 1) / n) - 1
    rows = rows.select((F.col("id") % 4).alias("run_id"), F.col("id").alias("shard"), lower.alias("lower_id"), upper.alias("upper_id"))
    open_ = F.col("shard") % 9 == 4
    rows = rows.withColumn("next_id", F.when(open_, F.col("lower_id") + F.floor((F.col("upper_id") - F.col("lower_id")) / 3)).otherwise(F.col("upper_id") + 1))
    return rows.withColumn("status", F.when(open_, "running").otherwise("completed")).withColumn("error", F.when(open_, F.concat(F.lit("e"), F.col("shard")))).withColumn("at", F.col("shard") / 8.0)


def two_pass_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as two passes over the keys of an order.

    Dealt by order once, over tasks that grow with the rows: the join here and the folds
    after it keep to that, so a task's memory doesn't grow with the table.
    """
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), (F.col("l_suppkey") % 2 + 1).alias("pass"), F.col("l_linenumber").alias("key"))
    li = li.repartition(tasks_for(li, ROWS_PER_TASK), "scan_id")
    size = li.groupBy("scan_id").agg(F.count_distinct("key").alias("expected"))
    return li.join(size, "scan_id")


def remote_local(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order ids by day: all are remote, those with a line item are local."""
    o = load(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("created_at"))
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("id")).distinct()
    return o, o.join(li, "id", "left_semi")
