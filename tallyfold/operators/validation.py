"""Checks that decide what of a landed batch may enter the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import parse_keys


def check_identity(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Positional pairing (batch, position): ok, missing (null) or mismatch.

    The id must be equal; the node id as well where the request names one.
    """
    got = received.select("batch", "position", F.col("account_id").alias("got_id"), F.col("node_id").alias("got_node"))
    rows = requested.join(got, ["batch", "position"], "left")
    node_ok = F.col("node_id").isNull() | F.col("node_id").eqNullSafe(F.col("got_node"))
    verdict = F.when(F.col("got_id").isNull(), "missing").when((F.col("account_id") == F.col("got_id")) & node_ok, "ok").otherwise("mismatch")
    return rows.withColumn("verdict", verdict)


def validate_key_snapshots(scans: DataFrame, stated: bool = True) -> DataFrame:
    """Scans of responses with ``reason``: null when the snapshot may be used.

    ``stated``: whether the source names fingerprints, which then must equal the
    computed ones.  Rows: batch, position, created_at, total, has_more, cursor,
    keys array<struct<raw, stated>>.
    """
    each = scans.select("batch", "position", F.posexplode("keys").alias("at", "k"))
    each = parse_keys(each.select("batch", "position", "k.raw", "k.stated"), "raw")
    differs = ~F.col("text").eqNullSafe(F.col("stated")) if stated else F.lit(False)
    per = each.groupBy("batch", "position").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("text").alias("n_distinct"),
        F.count_if(F.col("reason").isNotNull()).alias("n_bad"),
        F.count_if(F.col("reason").isNull() & differs).alias("n_differ"),
    )
    rows = scans.join(per, ["batch", "position"], "left").na.fill(0, ["n", "n_distinct", "n_bad", "n_differ"])
    reason = (
        F.when(F.col("created_at").isNull(), "no creation time")
        .when(F.col("n_bad") > 0, "malformed key")
        .when(F.col("n_differ") > 0, "fingerprint differs")
        .when(F.col("n_distinct") < F.col("n"), "duplicate key")
        .when(F.coalesce("total", F.lit(-1)) < F.col("n"), "total below keys")
        .when(~F.coalesce("has_more", F.lit(False)) & (F.col("total") != F.col("n")), "total differs on last page")
        .when(F.coalesce("has_more", F.lit(False)) & ((F.col("total") <= F.col("n")) | (F.coalesce("cursor", F.lit("")) == "")), "more pages without cursor or keys")
    )
    return rows.withColumn("reason", reason).drop("n_distinct", "n_bad", "n_differ")


def normalize_rest_snapshots(scans: DataFrame) -> DataFrame:
    """The same for sources that state no fingerprints."""
    return validate_key_snapshots(scans, stated=False)


def select_owner_results(results: DataFrame, owners: DataFrame) -> DataFrame:
    """Results that show keys or belong to an account that is already an owner."""
    known = owners.select("account_id").distinct().withColumn("_owner", F.lit(True))
    return results.join(known, "account_id", "left").filter("n_keys > 0 or _owner").drop("_owner")


def set_digest(key: str) -> list[Column]:
    """Aggregates that are equal for equal sets of distinct keys: their number and two sums of 64-bit hashes.

    Order-free and mergeable, so they combine before the shuffle, and a set of any size is
    three numbers; two different sets agree by chance once in 2**128.
    """
    known = F.col(key).isNotNull()
    sums = [F.sum(F.when(known, F.xxhash64(F.lit(k), key).cast("decimal(20,0)"))).alias(f"h{k}") for k in (1, 2)]
    return [F.count(key).alias("size"), *sums]


def scan_two_pass(pages: DataFrame) -> DataFrame:
    """Per scan: whether two passes agree, so that it may be published, or why not.

    ``pages``: (scan_id, pass, key, expected).  Keys are counted one by one and passes
    compared by digests of their sets, so a scan of very many keys is spread and never
    gathered.
    """
    each = pages.groupBy("scan_id", "pass", "key").agg(F.count(F.lit(1)).alias("times"), F.max("expected").alias("expected"))
    per = each.groupBy("scan_id", "pass").agg(F.sum("times").alias("observed"), F.struct(*set_digest("key")).alias("keys"), F.max("expected").alias("expected"))
    one = [F.max(F.when(F.col("pass") == p, F.struct("observed", "keys", "expected"))).alias(f"p{p}") for p in (1, 2)]
    rows = per.groupBy("scan_id").agg(*one)

    def whole(p: str):
        return (F.col(f"{p}.observed") == F.col(f"{p}.keys.size")) & (F.col(f"{p}.observed") == F.col(f"{p}.expected"))

    reason = (
        F.when(F.col("p1").isNull() | F.col("p2").isNull(), "pass missing")
        .when(~whole("p1"), "first pass unstable")
        .when(~whole("p2"), "second pass unstable")
        .when(~F.col("p1.keys").eqNullSafe(F.col("p2.keys")), "passes differ")
    )
    return rows.select("scan_id", reason.isNull().alias("stable"), reason.alias("reason"), F.when(reason.isNull(), F.col("p2.keys.size").cast("int")).alias("n_keys"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in just one of two tables."""
    return a.subtract(b).unionByName(b.subtract(a))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether two tables hold the same rows, whatever their order and repeats."""
    return symmetric_difference(a, b).limit(1).agg((F.count(F.lit(1)) == 0).alias("same"))


def audit_page_continuity(pages: DataFrame) -> DataFrame:
    """Per page of an id-range listing: ok, complete, or why its order can't be trusted.

    ``pages``: (shard, page, since, upper, next_since, ids).  Ids strictly increase
    from ``since``; once an id is beyond ``upper`` none in range may follow; the next
    cursor exists, moves forward and is not below the last id.
    """
    pairs = F.zip_with(F.concat(F.array("since"), F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))), F.col("ids"), lambda x, y: y <= x)
    falls = F.exists(F.when(F.size("ids") > 0, pairs).otherwise(F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(True)))
    last = F.coalesce(F.element_at(F.when(F.size("ids") > 0, F.col("ids")), -1), F.col("since"))
    done = (F.col("since") >= F.col("upper")) | (last >= F.col("upper"))
    verdict = (
        F.when(F.col("since") >= F.col("upper"), "complete")
        .when(falls, "ids do not increase")
        .when(done, "complete")
        .when(F.col("next_since").isNull(), "next cursor missing")
        .when((F.col("next_since") <= F.col("since")) | (F.col("next_since") < last), "cursor does not move on")
        .when(F.col("next_since") >= F.col("upper"), "complete")
        .otherwise("ok")
    )
    w = Window.partitionBy("shard").orderBy("page")
    rows = pages.withColumn("verdict", verdict).withColumn("last_id", last)
    gap = F.lag("next_since").over(w).isNotNull() & (F.lag("next_since").over(w) != F.col("since"))
    return rows.withColumn("follows", ~F.coalesce(gap, F.lit(False))).select("shard", "page", "since", "last_id", "verdict", "follows")


def audit_search_stability(pages: DataFrame, counts: DataFrame, cap: int = 1000) -> DataFrame:
    """Per partition: whether all pages and both counts tell the same story.

    ``pages``: (partition, page, total, incomplete, account_id) one row per item;
    ``counts``: (partition, pre_count, post_count).
    """
    per = pages.groupBy("partition").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.count_if("incomplete").alias("incomplete"), F.count("account_id").alias("items"), F.count_distinct("account_id").alias("ids"))
    rows = counts.join(per, "partition", "left").na.fill(0, ["low", "high", "incomplete", "items", "ids"])
    reason = (
        F.when(F.greatest("pre_count", "high") > cap, "over the cap")
        .when(F.col("incomplete") > 0, "incomplete page")
        .when(F.col("low") != F.col("high"), "total changed between pages")
        .when(F.col("items") != F.col("ids"), "identity twice")
        .when((F.col("pre_count") != F.col("post_count")) | (F.col("post_count") != F.col("ids")), "counts differ")
    )
    return rows.select("partition", "ids", "pre_count", "post_count", reason.isNull().alias("stable"), reason.alias("reason"))
