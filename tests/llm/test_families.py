"""Hot buckets of near copies: compared across components only, and nothing lost."""

from __future__ import annotations

import numpy as np
import pytest

from tallyfold.llm import near_dedup


def components(n: int, edges) -> list[int]:
    at = list(range(n))
    for _ in range(n):
        for i, j in edges:
            at[i] = at[j] = min(at[i], at[j])
    return at


def test_spanning_edges():
    """The same components as all pairs of different labels that may be similar."""
    draw = np.random.default_rng(2)
    for _ in range(60):
        n = int(draw.integers(2, 40))
        kinds = draw.integers(0, 4, n)
        base = draw.integers(0, 200, (4, near_dedup.REGISTERS))
        registers = base[kinds].astype(np.uint8)
        noise = draw.random(registers.shape) < draw.choice([0.1, 0.35, 0.45], n)[:, None]
        registers[noise] = draw.integers(0, 200, int(noise.sum()))
        label = np.where(draw.random(n) < draw.choice([0.2, 0.8]), 1000, draw.integers(0, 5, n))
        sizes = draw.choice([80, 100, 120, 300], n)
        got = list(near_dedup._spanning(np.arange(n), sizes, label, registers))
        pairs = [(i, j) for i in range(n) for j in range(i) if label[i] != label[j] and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j]) and (registers[i] == registers[j]).sum() >= near_dedup.LEAST_EQUAL]
        assert components(n, got) == components(n, pairs)
        assert all(label[i] != label[j] for i, j in got)


def copies(spark, n: int, outsiders: int):
    """n near copies of one text, texts that share its beginning, two of which are linked."""
    common = [f"c{k}" for k in range(200)]
    texts = [common + [f"t{k}" for k in range(60)] + [f"own{i}"] for i in range(n)]
    texts += [common + [f"x{i}y{k}" for k in range(62)] for i in range(outsiders)]
    texts[-1] = texts[-2][:-1] + ["last"]
    rows = [(int(d), " ".join(t)) for d, t in zip(np.random.default_rng(1).permutation(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string"), [d for d, _ in rows]


@pytest.mark.parametrize("part", [16, 100, 4096])
def test_hot_component_with_outsiders(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART_ROWS", part)
    n = 700
    docs, ids = copies(spark, n, 20)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = {d: d for d in ids} | {d: min(ids[:n]) for d in ids[:n]} | {d: min(ids[-2:]) for d in ids[-2:]}
    assert got == want


def test_parts_of_one_label_never_meet(spark, monkeypatch):
    """Every two members of different labels share a block; large labels are dealt over parts and not met with themselves."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 10)
    labels = [1] * 95 + [2] * 30 + list(range(100, 125))
    rows = [(0, "k", i, 50, label) for i, label in enumerate(labels)] + [(0, "small", i, 50, i % 2) for i in range(6)] + [(0, "one", i, 50, 7) for i in range(30)]
    blocks: dict = {}
    for r in near_dedup._blocks(spark.createDataFrame(rows, "band int, key string, id long, n long, label long")).collect():
        blocks.setdefault((r["key"], r["p"]), []).append((r["id"], r["label"]))
    assert {k for k, _ in blocks} == {"k", "small"}
    met = {frozenset((a, b)) for members in blocks.values() for a, la in members for b, lb in members if la != lb}
    assert met >= {frozenset((a, b)) for a, la in enumerate(labels) for b, lb in enumerate(labels) if la != lb}
    assert max(len(m) for (k, _), m in blocks.items() if k == "k") < 60
    inside = sum(la == lb == 1 for (k, p), members in blocks.items() if k == "k" for i, (_, la) in enumerate(members) for _, lb in members[:i])
    assert inside < 20 * 95 * 10  # pairs inside the largest label are those of its own parts
