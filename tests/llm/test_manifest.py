"""The Merkle manifest against a tree built by hand."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from tallyfold.llm import manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text) -> str:
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climbed(nodes: list[str]) -> tuple[str, list[str]]:
    """(root, proof of each node) of one tree."""
    proofs, owners = [""] * len(nodes), [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for o in owners[i]:
                    proofs[o] += "".join(nodes[j] for j in run if j != i)
        owners = [[o for i in run for o in owners[i]] for run in runs]
        nodes = [H(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], proofs


def by_hand(rows) -> list[tuple]:
    sources: dict = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"], leaf_of(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = own, *climbed([x[1] for x in own])
    root, above = climbed([trees[s][1] for s in names])
    out = []
    for s, high in zip(names, above):
        own, subroot, proofs = trees[s]
        for (doc_id, leaf, r), low in zip(own, proofs):
            tampers = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r["text"] is not None and "\n" in r["text"]
            out.append((doc_id, leaf, subroot, root, H(low + high), not tampers))
    return sorted(out, key=repr)


def got_from(docs) -> list[tuple]:
    rows = manifest.verify(manifest.manifest(docs)).collect()
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in rows)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in rows), key=repr)


def odd(spark, docs):
    """Null doc_ids, repeated rows, rows that share a doc_id, one hot source."""
    nothing = spark.range(4).selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in docs.dtypes])
    hot = spark.range(60).selectExpr("id * 7 as doc_id", "concat('line\\n', id % 50) as text", "'en' as lang", "'hot' as source", "id as n_chars", "'' as slot", "'' as rank", "'' as base")
    return docs.unionByName(nothing).unionByName(hot).unionByName(hot.limit(9))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_by_hand(spark, docs, levels, monkeypatch):
    """Few levels a round make several rounds of blocks."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    whole = odd(spark, docs).cache()
    assert got_from(whole.repartition(5)) == by_hand(whole.collect())


def test_manifest_small(spark, docs, empty):
    assert manifest.verify(manifest.manifest(empty)).count() == 0
    one = docs.limit(1)
    (row,) = manifest.verify(manifest.manifest(one)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == [] and row["proof_sha256"] == H("")


def test_tampering_is_found(spark):
    """A row is proved from the root alone; every other change of a field gives another root."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('a\\nb', id) as text", "'en' as lang", "concat('s', id % 3) as source", "id as n_chars")
    rows = manifest.verify(manifest.manifest(docs)).collect()
    assert {r["verified"] for r in rows} == {True, False}
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 != 0)
        node = r["leaf"]
        for step in r["steps"]:
            node = H(step["left"], node, step["right"])
        assert node == r["root"] == rows[0]["root"]
    other = docs.selectExpr("doc_id", "if(doc_id = 7, text || ' ', text) as text", "lang", "source", "n_chars")
    assert manifest.manifest(other).first()["root"] != rows[0]["root"]
