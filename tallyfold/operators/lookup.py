"""Which accounts hold or held a key, and the listings around that question.

A match says that a key was published under an account, not who that is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normalize_fingerprints
from ..session import stored

#: Values of one IN that Spark hands to the Parquet reader one by one (its default).
IN_FILTER = 10
#: Queries up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_QUERIES = 1_000_000


def profile_url(login: Column | str, base: str = "https://example.org/") -> Column:
    """The address of an account's page."""
    return F.concat(F.lit(base), F.col(login) if isinstance(login, str) else login)


def alias_list(aliases: DataFrame) -> DataFrame:
    """(account_id, aliases): logins ordered by first seen, then name without case."""
    item = F.struct("first_seen_at", F.lower("login").alias("low"), "login", "present")
    rows = aliases.groupBy("account_id").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return rows.select("account_id", F.transform("a", lambda x: F.struct(x["login"].alias("login"), x["present"].alias("present"))).alias("aliases"))


def lookup_rows(queries: DataFrame, history: DataFrame, owners: DataFrame, aliases: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """Per query and match a row, with the query's number of matches; an unmatched query is one row.

    ``queries``: (query_id, value), value being any spelling of a fingerprint or a
    key line; ``history``: key is a canonical fingerprint text.  Owners and aliases
    are reduced to the accounts that match before anything is gathered, a match whose
    account is no owner (yet) has no login, and no list
    of matches is made, so a key that very many accounts share is many rows.
    """
    queries = stored(normalize_fingerprints(queries.select("query_id", "value"), "value").withColumnRenamed("normal", "key"), "asked")
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    asked = F.broadcast(queries) if few else queries
    hits = stored(history.join(asked.select("query_id", "key"), "key"), "hits")
    found = hits.select("account_id").distinct()
    names = owners.select("account_id", "login").join(found, "account_id", "left_semi")
    also = alias_list(aliases.join(found, "account_id", "left_semi"))
    rows = hits.join(names, "account_id", "left").join(also, "account_id", "left")
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matches"))
    none = F.array().cast("array<struct<login: string, present: boolean>>")
    rows = rows.select("query_id", "account_id", "login", profile_url("login", base).alias("url"), "first_seen_at", "last_seen_at", "present", "removed_at", F.coalesce("aliases", none).alias("aliases"))
    out = queries.join(counts, "query_id", "left").join(rows, "query_id", "left")
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def write_index(history: DataFrame, path: str, key: str = "key") -> None:
    """A history laid out for lookups: ranges of the key in files, sorted, with Bloom filters.

    A key shared by very many accounts takes several files: the account is in the order.
    """
    laid = history.repartitionByRange(key, "account_id").sortWithinPartitions(key, "account_id")
    sized = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(8 << 20)}
    laid.write.options(**sized).parquet(path)


#: Keys asked for by filters that files' statistics can answer; more by a join.
FEW_KEYS = 500


def read_index(history: DataFrame, queries: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a laid-out history that queries (query_id, value) can match.

    At most FEW_KEYS keys become filters of the scan, so files and row groups without
    them are not read; for more the history is joined as it is.
    """
    wanted = normalize_fingerprints(queries.select("query_id", "value"), "value").select("normal").filter("normal is not null").distinct()
    keys = [r[0] for r in wanted.limit(FEW_KEYS + 1).collect()]
    if len(keys) > FEW_KEYS:
        return history
    # one condition a key: a list would be cut to its least and greatest for the scan
    spread = [keys[i : i + IN_FILTER] for i in range(0, len(keys), IN_FILTER)]
    return history.filter(reduce(Column.__or__, [F.col(key).isin(some) for some in spread], F.lit(False)))


def reverse_lookup(queries: DataFrame, history: DataFrame, owners: DataFrame, aliases: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """The same with the matches of a query in one array, current ones first, then by login.

    For keys whose holders fit in a row; ``lookup_rows`` has no such bound.
    """
    rows = lookup_rows(queries, history, owners, aliases, base)
    match = F.struct((~F.col("present")).alias("past"), F.lower("login").alias("low"), "account_id", "login", "url", "first_seen_at", "last_seen_at", "present", "removed_at", "aliases")
    return rows.groupBy("query_id", "key", "n_matches").agg(F.array_sort(F.collect_list(F.when(F.col("account_id").isNotNull(), match))).alias("matches"))


def shared_keys(history: DataFrame) -> DataFrame:
    """Keys that more than one account held, ever and now; holders stay rows elsewhere."""
    out = history.groupBy("key").agg(F.count(F.lit(1)).alias("accounts_ever"), F.count_if("present").alias("accounts_now"), F.min("first_seen_at").alias("first_seen_at"))
    return out.filter("accounts_ever > 1")


def users_export(owners: DataFrame, history: DataFrame, as_of: Column | None = None, base: str = "https://example.org/") -> DataFrame:
    """One row per account with its keys; both are filtered by ``as_of``."""
    if as_of is not None:
        owners, history = owners.filter(F.col("first_seen_at") <= as_of), history.filter(F.col("first_seen_at") <= as_of)
    item = F.struct("key", "first_seen_at", "last_seen_at", "present", "removed_at")
    keys = history.groupBy("account_id").agg(F.array_sort(F.collect_list(item)).alias("keys"))
    out = owners.join(keys, "account_id", "left")
    return out.select("account_id", "login", profile_url("login", base).alias("url"), "first_seen_at", F.coalesce(F.size("keys"), F.lit(0)).alias("n_keys"), "keys")


def keyset_page(owners: DataFrame, after_id: int, snapshot: Column, limit: int) -> DataFrame:
    """One page of owners after an id, as of a snapshot, with has_more and next_after."""
    rows = owners.filter((F.col("account_id") > after_id) & (F.col("first_seen_at") <= snapshot)).orderBy("account_id").limit(limit + 1)
    numbered = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("account_id", "login", "first_seen_at"))).alias("all"))
    page = numbered.select((F.size("all") > limit).alias("has_more"), F.slice("all", 1, limit).alias("page"))
    page = page.withColumn("next_after", F.when(F.col("has_more"), F.element_at("page", -1)["account_id"]))
    return page.select("has_more", "next_after", F.explode("page").alias("r")).select("r.account_id", "r.login", "r.first_seen_at", "has_more", "next_after")


def index_totals(owners: DataFrame, history: DataFrame) -> DataFrame:
    """Exact totals of owners, keys, associations and current associations."""
    pairs = history.agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("associations"), F.count_if("present").alias("current_associations"))
    return owners.agg(F.count(F.lit(1)).alias("owners")).crossJoin(pairs)
