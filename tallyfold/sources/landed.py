"""Landed JSON files as rows: listing pages, search pages, key responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LISTING_PAGES, RESPONSES, SEARCH_PAGES


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an explicit schema, one a line; what can't be parsed stays in _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", schema, options).alias("r")).select("r.*")


def whole_lines(df: DataFrame) -> DataFrame:
    """Rows of lines that could be parsed."""
    return df.filter("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in df.columns else df


def corrupt_lines(df: DataFrame) -> DataFrame:
    """(line) of what could not be parsed."""
    return df.filter("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, LISTING_PAGES)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SEARCH_PAGES)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RESPONSES)


def accounts_from_listing(pages: DataFrame) -> DataFrame:
    """One row per user of listing pages: type "User" with a node id, the last page wins."""
    rows = whole_lines(pages).select("page", F.inline("objects")).filter("type = 'User' and coalesce(node_id, '') <> ''")
    last = rows.groupBy(F.col("id").alias("account_id")).agg(F.max_by(F.struct("node_id", "login"), F.struct("page", "node_id", "login")).alias("a"))
    return last.select("account_id", "a.node_id", "a.login")


def accounts_from_search(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identities, rejects): items of search pages; rejects lack a user type, id, node or login."""
    rows = whole_lines(pages).select("partition", "page", F.inline("items"))
    whole = (F.coalesce("type", F.lit("")) == "User") & (F.coalesce("id", F.lit(0)) > 0) & (F.coalesce("node_id", F.lit("")) != "") & (F.coalesce("login", F.lit("")) != "")
    return rows.filter(whole).select("partition", F.col("id").alias("account_id"), "node_id", "login"), rows.filter(~whole)


def scans_from_responses(responses: DataFrame) -> DataFrame:
    """One row per requested account; a null node is a "missing" scan without keys."""
    node = F.col("node")
    return whole_lines(responses).select(
        "batch",
        "position",
        "requested_id",
        F.when(node.isNull(), "missing").otherwise("ok").alias("status"),
        node["databaseId"].alias("account_id"),
        node["id"].alias("node_id"),
        node["login"].alias("login"),
        node["createdAt"].alias("created_at"),
        node["publicKeys"]["totalCount"].alias("total"),
        node["publicKeys"]["pageInfo"]["hasNextPage"].alias("has_more"),
        node["publicKeys"]["pageInfo"]["endCursor"].alias("cursor"),
        F.transform(node["publicKeys"]["nodes"], lambda k: F.struct(k["key"].alias("raw"), k["fingerprint"].alias("stated"))).alias("keys"),
    )
