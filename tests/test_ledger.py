"""Commits, pins, removal and log-structured runs."""

from __future__ import annotations

import threading

import pytest

from tallyfold.sources import ledger

ROWS = "k long, x string"


def test_second_writer_of_a_version_conflicts(spark, tmp_path):
    root = str(tmp_path)
    path = ledger.write_ledger(spark.range(3), root, "t", 1, writer="a")
    with pytest.raises(ledger.Conflict):
        ledger.write_ledger(spark.range(5), root, "t", 1, writer="b")
    with pytest.raises(ledger.Conflict):
        ledger.write_ledger(spark.range(5), root, "t", 1)
    assert ledger.write_ledger(spark.range(9), root, "t", 1, writer="a") == path  # the job ran again
    assert ledger.read_ledger(spark, root, "t").count() == 3
    assert [n for n in ledger._names(spark, f"{root}/t") if n.startswith("v=")] == [path.rpartition("/")[2]]
    ledger.write_ledger(spark.range(4), root, "t", 3)
    with pytest.raises(ledger.Conflict):  # nothing is slipped in below the newest
        ledger.write_ledger(spark.range(5), root, "t", 2)


def test_concurrent_commits(spark, tmp_path):
    """Of eight writers that start from one version one publishes."""
    root, start, won = str(tmp_path), threading.Barrier(8), []

    def write(i: int) -> None:
        start.wait()
        try:
            ledger.commit(spark, root, 1, {"writer": i})
            won.append(i)
        except ledger.Conflict:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and ledger.read_commit(spark, root) == (1, {"writer": won[0]})
    assert [n for n in ledger._names(spark, f"{root}/_commits") if n.startswith(".") and not n.endswith(".crc")] == []


def test_pinned_versions_stay(spark, tmp_path):
    root = str(tmp_path)
    for version in range(1, 6):
        ledger.write_ledger(spark.range(version), root, "t", version)
        if version == 2:
            assert ledger.pin(spark, f"{root}/t", "report") == 2
    assert ledger.remove_versions(spark, root, "t", keep=2) == [1, 3]
    assert ledger.read_ledger(spark, root, "t", version=2).count() == 2
    ledger.unpin(spark, f"{root}/t", "report")
    assert ledger.remove_versions(spark, root, "t", keep=2) == [2]
    with pytest.raises(ValueError):
        ledger.read_ledger(spark, root, "t", version=2)
    assert ledger.read_ledger(spark, root, "none") is None and ledger.remove_versions(spark, root, "none") == []


def add(spark, root: str, rows: list[tuple], table: str = "t") -> None:
    version, content = ledger.read_commit(spark, root)
    path = ledger.write_run(spark.createDataFrame(rows, ROWS), root, table, version + 1, "k")
    ledger.commit(spark, root, version + 1, ledger.add_run(content, table, path))


def newest(spark, root: str, only=None, version: int | None = None) -> dict:
    content = ledger.read_commit(spark, root, version)[1]
    return {r["k"]: r["x"] for r in ledger.read_runs(spark, root, content, "t", ROWS, ["k"], only).collect()}


def test_newest_row_wins_through_merges(spark, tmp_path):
    """A merged run holds older rows than a run of a lower level that was written before the merge."""
    root, want = str(tmp_path), {}
    for i in range(1, 22):
        rows = [(k, f"{k}-{i}") for k in range(i % 3, 12, 1 + i % 4)]
        want |= dict(rows)
        add(spark, root, rows)
        ledger.compact(spark, root, {"t": (ROWS, ["k"])})
        runs = ledger.read_commit(spark, root)[1]["tables"]["t"]
        assert max(sum(r["level"] == k for r in runs) for k in range(4)) < ledger.FANOUT
        if i % 5 == 0:
            assert newest(spark, root) == want
            assert newest(spark, root, [1, 5, 99]) == {k: v for k, v in want.items() if k in (1, 5)}
            assert newest(spark, root, spark.createDataFrame([(2,)], "k long")) == {2: want[2]}
    assert newest(spark, root) == want and max(r["level"] for r in runs) == 2


def test_merged_runs_go(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        add(spark, root, [(i, str(i))])
    held = ledger.pin(spark, root, "reader")
    assert ledger.compact(spark, root, {"t": (ROWS, ["k"])}) == 1
    ledger.write_run(spark.createDataFrame([(9, "x")], ROWS), root, "t", 6, "k")  # of a writer that is still at work
    ledger.vacuum(spark, root, keep=1)
    assert len(ledger._names(spark, f"{root}/t")) == 6 and newest(spark, root, version=held) == newest(spark, root)
    ledger.unpin(spark, root, "reader")
    ledger.vacuum(spark, root, keep=1)
    assert len(ledger._names(spark, f"{root}/t")) == 2 and newest(spark, root) == {i: str(i) for i in range(4)}


def test_few_keys_read_few_row_groups(spark, tmp_path):
    """A lookup of a key reads a small part of a run: rows are sorted and statistics kept."""
    root = str(tmp_path)
    rows = spark.range(400_000).selectExpr("id as k", "sha2(string(id), 256) as x").coalesce(1)
    path = ledger.write_run(rows, root, "t", 1, "k")
    ledger.commit(spark, root, 1, ledger.add_run({}, "t", path))
    size = sum(f.getLen() for f in [s for s in ledger._place(spark, f"{root}/{path}")[0].listStatus(ledger._place(spark, f"{root}/{path}")[1])])
    before = bytes_moved(spark)[0]
    assert len(newest(spark, root, [77, 78])) == 2
    assert bytes_moved(spark)[0] - before < size / 3


def bytes_moved(spark) -> tuple[int, int]:
    """Bytes this JVM has read from and written to local files so far."""
    found = [s for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file"]
    return sum(s.getBytesRead() for s in found), sum(s.getBytesWritten() for s in found)
