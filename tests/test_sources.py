from __future__ import annotations

from tallyfold.sources import landed, ledger


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "pages")
    lines = ['{"page": 2, "objects": [{"id": 7, "node_id": "U_7", "login": "b", "type": "User"}, {"id": 8, "node_id": "", "login": "c", "type": "User"}]}', '{"page": 1, "objects": [{"id": 7, "node_id": "U_7", "login": "a", "type": "User"}]}', '{"page": 3, "objects": [', "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    pages = landed.read_listing(spark, path)
    assert [tuple(r) for r in landed.accounts_from_listing(pages).collect()] == [(7, "U_7", "b")]
    assert sorted(r["line"] for r in landed.corrupt_lines(pages).collect()) == sorted(lines[2:])
    answers = ['{"batch": 1, "position": 0, "requested_id": 5, "node": null}', '{"batch": 1, "position": 1,']
    spark.createDataFrame([(x,) for x in answers], "value string").coalesce(1).write.text(path + "2")
    got = landed.scans_from_responses(landed.read_responses(spark, path + "2")).collect()
    assert [(r["requested_id"], r["status"]) for r in got] == [(5, "missing")]


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    for version in range(1, 5):
        ledger.write_ledger(spark.range(version), root, "t", version)
    assert ledger.remove_versions(spark, root, "t", keep=2) == [1, 2]
    assert ledger.read_ledger(spark, root, "t").count() == 4 and ledger.remove_versions(spark, root, "t", keep=2) == []
