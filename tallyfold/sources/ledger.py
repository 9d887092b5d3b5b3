"""Derived tables published by commits: readers see one version whole, writers never overwrite.

A table folder holds data in directories with fresh names and ``_commits/<version>.json``,
small files that say which directories a version is made of.  A commit is written aside
and renamed to its name, which fails if the name is taken: of two writers that start from
one version the second gets a ``Conflict`` and has published nothing.  A reader that pins a
version keeps its data until it lets go; ``vacuum`` deletes what no kept or pinned version
names.

On top stand log-structured tables.  A *run* is one write of rows, sorted by key; a
version of a table is a list of runs, and of rows with equal keys the one of the newest
run counts.  A batch adds a run of the rows that changed, whatever the table's size;
``compact`` merges FANOUT runs of one level into one of the next, so that a row is written
again once a level and a reader meets few runs.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published this version."""


# --- files ---------------------------------------------------------------------


def _place(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, place = _place(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of that name; tells whether it did."""
    files, place = _place(spark, path)
    files.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), options)
        return True
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise


def _text(spark: SparkSession, path: str) -> str:
    files, place = _place(spark, path)
    with_in = files.open(place)
    try:
        return bytes(with_in.readAllBytes()).decode()
    finally:
        with_in.close()


# --- commits -------------------------------------------------------------------


def _commit_path(root: str, version: int) -> str:
    return f"{root}/_commits/{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/_commits") if n.endswith(".json") and not n.startswith("."))


def commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Publish ``content`` as ``version``; raises Conflict if there is such a version or a newer one."""
    newest = max(versions(spark, root), default=0)
    if newest >= version or not put_new(spark, _commit_path(root, version), json.dumps(content)):
        raise Conflict(f"version {version} of {root} is published")


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(version, content) of the newest commit or of a given one; (0, {}) before the first."""
    found = versions(spark, root)
    if version is None:
        version = found[-1] if found else 0
    elif version not in found:
        raise ValueError(f"{root} has no version {version}")
    return (version, json.loads(_text(spark, _commit_path(root, version)))) if version else (0, {})


def pin(spark: SparkSession, root: str, reader: str, version: int | None = None) -> int:
    """Keep a version (the newest) for a reader until ``unpin``; returns it."""
    while True:
        wanted = read_commit(spark, root, version)[0]
        _remove(spark, f"{root}/_pins/{reader}")
        put_new(spark, f"{root}/_pins/{reader}", str(wanted))
        if wanted in versions(spark, root):  # not deleted before the pin was there
            return wanted
        if version is not None:
            raise ValueError(f"{root} has no version {version}")


def unpin(spark: SparkSession, root: str, reader: str) -> None:
    _remove(spark, f"{root}/_pins/{reader}")


def _named_in(content: dict) -> set[str]:
    return {content["path"]} if "path" in content else {run["path"] for runs in content.get("tables", {}).values() for run in runs}


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions and the pinned ones, and data no other version names.

    Returns the versions deleted.  Data of a writer that hasn't committed is named by
    nobody: it is left alone if it is meant for a version newer than the newest.
    """
    found = versions(spark, root)
    pinned = {int(_text(spark, f"{root}/_pins/{n}")) for n in _names(spark, f"{root}/_pins") if not n.startswith(".")}
    gone = [v for v in (found[:-keep] if keep else found) if v not in pinned]
    held = set().union(*(_named_in(read_commit(spark, root, v)[1]) for v in found if v not in gone))
    for version in gone:
        _remove(spark, _commit_path(root, version))
    newest = found[-1] if found else 0
    folders = [n for n in _names(spark, root) if n[:1] not in "_."]
    data = [n for n in folders if n.startswith("v=")] + [f"{t}/{n}" for t in folders for n in _names(spark, f"{root}/{t}") if n.startswith("v=")]
    for name in data:
        meant = int(name.rpartition("v=")[2].split("-")[0])
        if name not in held and meant <= newest:
            _remove(spark, f"{root}/{name}")
    return gone


def _fresh(version: int) -> str:
    return f"v={version}-{uuid.uuid4().hex[:12]}"


# --- whole tables ----------------------------------------------------------------


def write_ledger(df: DataFrame, root: str, name: str, version: int, writer: str | None = None) -> str:
    """Publish a table as ``version``; returns its path.

    A job that is run again names itself as ``writer``: a version it has published before
    is left as it is.  A version of another writer raises Conflict, and nothing is left.
    """
    spark, home = df.sparkSession, f"{root}/{name}"
    if writer is not None and version in versions(spark, home):
        held = read_commit(spark, home, version)[1]
        if held.get("writer") == writer:
            return f"{home}/{held['path']}"
    path = _fresh(version)
    df.write.parquet(f"{home}/{path}")
    try:
        commit(spark, home, version, {"path": path, "writer": writer})
    except Conflict:
        _remove(spark, f"{home}/{path}")
        raise
    return f"{home}/{path}"


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The newest published version; None before the first."""
    return read_commit(spark, f"{root}/{name}")[0] or None


def read_ledger(spark: SparkSession, root: str, name: str, schema: str | None = None, version: int | None = None) -> DataFrame | None:
    """The newest version, or a pinned one; None before the first."""
    version, content = read_commit(spark, f"{root}/{name}", version)
    if not version:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{name}/{content['path']}")


def remove_versions(spark: SparkSession, root: str, name: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` published versions; returns those deleted."""
    return vacuum(spark, f"{root}/{name}", keep)


# --- log-structured tables ---------------------------------------------------------

#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Keys that are looked up by filters the files' statistics can answer; more by a join.
FEW_KEYS = 500
NEWEST = "_run"


def write_run(df: DataFrame, root: str, table: str, version: int, key: str) -> str:
    """Write rows as a run for a commit of ``version``: sorted by key, with Bloom filters on it."""
    path = f"{table}/{_fresh(version)}"
    rows = df if NEWEST in df.columns else df.withColumn(NEWEST, F.lit(version).cast("long"))
    ordered = rows.sortWithinPartitions(key)
    # filters grow with the keys of a file; else each takes a megabyte
    sized = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(16 << 20)}
    ordered.write.options(**sized).parquet(f"{root}/{path}")
    return path


def add_run(content: dict, table: str, path: str, level: int = 0) -> dict:
    """Content of a commit with one more run of a table, the newest."""
    runs = [*content.get("tables", {}).get(table, []), {"path": path, "level": level}]
    return content | {"tables": content.get("tables", {}) | {table: runs}}


def nothing(spark: SparkSession, fields: str) -> DataFrame:
    """No rows of a schema, known as such to the optimizer."""
    return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(fields).fields])


def _newest(spark: SparkSession, root: str, runs: list[dict], schema: str, keys: list[str], only=None) -> DataFrame:
    """The newest row of each key in some runs, with the version it was written for."""
    fields = f"{schema}, {NEWEST} long"
    if not runs:
        return nothing(spark, fields)
    rows = spark.read.schema(fields).parquet(*(f"{root}/{r['path']}" for r in runs))
    if isinstance(only, list):
        # of a longer list the reader would get the least and the greatest only
        some = [F.col(keys[0]).isin(only[i : i + 10]) for i in range(0, len(only), 10)]
        rows = rows.filter(reduce(Column.__or__, some, F.lit(False)))
    elif only is not None:
        rows = rows.join(only, keys[0], "left_semi")
    if len(runs) == 1:
        return rows
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), NEWEST).alias("_row"))
    return last.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns))


def read_runs(spark: SparkSession, root: str, content: dict, table: str, schema: str, keys: list[str], only: list | DataFrame | None = None) -> DataFrame:
    """The newest row of each key of a version.

    ``only``: values of the first key, or a DataFrame of them; a list of at most FEW_KEYS is
    pushed into the scan, where row groups without these keys are skipped.
    """
    return _newest(spark, root, content.get("tables", {}).get(table, []), schema, keys, only).drop(NEWEST)


def compact(spark: SparkSession, root: str, tables: dict[str, tuple[str, list[str]]]) -> int:
    """Merge runs where FANOUT of one level stand together; returns the number of merges.

    ``tables``: (schema, keys) by name.  Rows keep the version they were written for, so the
    order of runs doesn't matter.  Another writer's commit in between makes the merge void.
    """
    merged = 0
    while True:
        version, content = read_commit(spark, root)
        for table, (schema, keys) in tables.items():
            runs = content.get("tables", {}).get(table, [])
            level = next((k for k in sorted({r["level"] for r in runs}) if sum(r["level"] == k for r in runs) >= FANOUT), None)
            if level is not None:
                break
        else:
            return merged
        old = [r for r in runs if r["level"] == level]
        rows = _newest(spark, root, old, schema, keys)
        path = write_run(rows.repartition(F.col(keys[0])), root, table, version + 1, keys[0])
        left = [r for r in runs if r["level"] != level] + [{"path": path, "level": level + 1}]
        try:
            commit(spark, root, version + 1, content | {"tables": content["tables"] | {table: left}})
        except Conflict:
            _remove(spark, f"{root}/{path}")
            return merged
        merged += 1
