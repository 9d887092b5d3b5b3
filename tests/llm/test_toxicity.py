"""Toxic segments: the scan by brute force, the calibration by hand, accuracy on held-out rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from tallyfold.llm import toxicity as tox
from tallyfold.llm.common import table

from ..conftest import DATA


def maximal_by_definition(scores: list[int]) -> set[tuple[int, int, int]]:
    """Best segment (shortest, leftmost of equals) and the same left and right of it."""
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return set()
    a = -best[2]
    b = a - best[1]
    left, right = maximal_by_definition(scores[:a]), maximal_by_definition(scores[b:])
    return left | {(a, b, best[0])} | {(b + x, b + y, s) for x, y, s in right}


def test_maximal_segments():
    r = random.Random(8)
    for _ in range(1500):
        rest = -r.choice([1, 3, 10])
        scores = [r.choice([rest, rest, rest, r.randint(1, 12)]) for _ in range(r.randint(0, 24))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        found = {(hits[a][0], hits[b][0] + 1, s) for a, b, s in tox.maximal_segments(hits, rest)}
        # ties are broken in different ways: the sums must agree, and the parts where no tie is
        want = maximal_by_definition(scores)
        assert sorted(s for *_, s in found) == sorted(s for *_, s in want) or max(s for *_, s in found) == max(s for *_, s in want)
        distinct = [s * 1009 + r.randint(0, 300) if s > 0 else s * 1009 for s in scores]
        hits = [(i, s) for i, s in enumerate(distinct) if s > 0]
        assert {(hits[a][0], hits[b][0] + 1, s) for a, b, s in tox.maximal_segments(hits, rest * 1009)} == maximal_by_definition(distinct)


def test_scan_is_linear():
    hits = [(i, 1 + i % 5) for i in range(0, 1_000_000, 2)]
    assert sum(s for *_, s in tox.maximal_segments(hits, -2)) > 0
    assert len(tox.maximal_segments(hits, -6)) == len(hits)  # nothing merges


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def made(spark):
    """Clean prose with rare toxic words in a tenth of the rows."""
    r = random.Random(4)
    words = ["w" + "".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = r.choices(words, k=r.randint(10, 60))
        bad = i % 10 == 0
        if bad:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["Vilename", "rotten", "vermin", "vileword" + r.choice("abcdef")]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_made_rows(made):
    docs, labels = made
    got = tox.score_documents(docs, labels).collect()
    assert len(got) == 900
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    wrong = [r for r in got if r["held_out"] and r["predicted"] != (r["doc_id"] % 10 == 0)]
    assert len(wrong) <= 2
    texts = dict(docs.collect())
    for r in got:
        for p in r["passages"]:
            inside = texts[r["doc_id"]][p["begin"] : p["end"]].lower().split()
            assert inside[0].startswith(("vile", "rotten", "vermin")) and inside[-1].startswith(("vile", "rotten", "vermin"))


def test_labels_and_ids_are_no_inputs(made, spark):
    """Held-out labels change nothing; equal texts score alike under other ids; reruns agree."""
    docs, labels = made
    held = labels.selectExpr("doc_id", "quality", f"if(crc32(cast(cast(doc_id as string) as binary)) % {tox.HELD_OUT} = 0, 1 - toxic, toxic) as toxic")
    first = {r["doc_id"]: r["score"] for r in tox.score_documents(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in tox.score_documents(docs.repartition(3), held).collect()} == pytest.approx(first)
    more = docs.unionByName(docs.filter("doc_id < 50").selectExpr("doc_id + 5000000 as doc_id", "text"))
    again = {r["doc_id"]: r["score"] for r in tox.score_documents(more, labels).collect()}
    assert all(again[i] == again[i + 5000000] for i in range(50))


@pytest.mark.parametrize("most", [0, tox.WANTED])
def test_counts(made, most):
    """Both ways count alike."""
    docs, labels = made
    rows = docs.join(tox.roles(labels), "doc_id", "left")
    got = {r["token"]: tuple(r)[1:] for r in tox.token_counts(rows, most).collect()}
    toxic, clean, everywhere = Counter(), Counter(), Counter()
    for r in rows.collect():
        tokens = set(r["text"].lower().split())
        features = [*tokens, *(t[:k] + "*" for t in tokens for k in range(4, 9) if k < len(t))]
        for of, wanted in ((everywhere, True), (toxic, r["role"] == tox.TEACH_TOXIC), (clean, r["role"] == tox.TEACH_CLEAN)):
            if wanted:
                of.update(features)
                of[None] += len(tokens)
    assert got == {t: (toxic[t], clean[t], everywhere[t]) for t in everywhere if t is None or toxic[t] >= tox.LEAST_DOCS}


def test_evidence(spark):
    """The sum statistic and the best passage, by their formulas."""
    scanned = spark.createDataFrame([(1, 100, [(0, 5, 9000), (9, 12, 7000), (20, 21, 1000)]), (2, 100, [(0, 2, 2000)]), (3, 0, []), (4, 10, [(0, 2, 900_000)])], f"doc_id int, n_tokens long, segments {tox.SEGMENTS}")
    rate = 0.001
    got = {r["doc_id"]: r for r in tox.with_evidence(scanned, rate).collect()}
    nats = [s - math.log(100 * rate) for s in (9, 7)]
    total = sum(nats)
    assert got[1]["evidence"] == pytest.approx(total - math.log(total) + math.log(2)) and len(got[1]["passages"]) == 2
    e = 100 * rate * math.exp(-2)
    assert got[2]["evidence"] == pytest.approx(-math.log(1 - math.exp(-e))) and got[2]["passages"] == []
    assert got[3]["evidence"] == 0 and got[4]["evidence"] == pytest.approx(900 - math.log(10 * rate))


def test_odd_rows(spark, docs, empty, made):
    whole = docs.unionByName(spark.range(2).selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in docs.dtypes]))
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (3, None, None), (6, 1, 0), (999, 0, 1)], LABELS)
    rows = tox.score_documents(whole, labels).collect()
    assert len(rows) == whole.count()
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    none = tox.score_documents(whole, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and all(r["predicted"] == 0 and r["evidence"] == 0 for r in none)
    assert tox.score_documents(empty, labels).count() == 0 and tox.score_documents(empty, labels.limit(0)).count() == 0
    docs2, labels2 = made
    blank = docs2.unionByName(spark.createDataFrame([(9001, ""), (9002, None), (9003, "İ ß\n")], docs2.schema))
    got = {r["doc_id"]: r for r in tox.score_documents(blank, labels2).filter("doc_id > 9000").collect()}
    assert all(got[i]["predicted"] == 0 and got[i]["evidence"] == 0 for i in (9001, 9002, 9003))


def test_held_out_accuracy(spark):
    """On the smallest tables; README states the larger ones."""
    labels = table(spark, DATA.replace("0.001", "0.01"), "labels")
    got = tox.score_documents(table(spark, DATA.replace("0.001", "0.01"), "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right / len(got) >= 0.94
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 0.02 * len(got)
