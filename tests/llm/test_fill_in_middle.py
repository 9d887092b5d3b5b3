"""Fill-in-middle outputs against the definition, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallyfold.llm import fill_in_middle as fim


def by_hand(doc_id, text: str, rate: int = fim.RATE) -> tuple:
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(n: int) -> list[str]:
    r = random.Random(3)
    parts = ["\n", "a", "line", " ", "<", "P>", "S>", "é", "日本", "👍", "\r\n", "\x85", " ", "<P", "<M>"]
    weights = [6, *[3] * 13, 0.3]
    return ["".join(r.choices(parts, weights, k=r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
@pytest.mark.parametrize("rate", [100, 40])
def test_batches(piece, rate, monkeypatch):
    """Any size of the moved pieces, across texts and parts, empty parts and empty texts."""
    monkeypatch.setattr(fim, "PIECE", piece)
    texts = ["", "", "\n", "x", *some_texts(600), ""]
    ids = [None, *range(1, len(texts))]
    got = fim.transform_batch(ids, [t.encode() for t in texts], rate=rate)
    outputs = [bytes(got["out"][a:b]) for a, b in zip(got["offsets"], got["offsets"][1:])]
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        _, n, form, prefix, middle, output = by_hand(doc_id, text, rate)
        assert (got["n"][i], got["form"][i], outputs[i].decode()) == (n, form, output)
        if form != "plain":
            assert (got["prefix_chars"][i], got["middle_chars"][i]) == (prefix, middle)
    assert len(set(got["form"])) == 3
    text, offsets = fim.restore_batch(got["form"].tolist(), outputs)
    assert [bytes(text[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == texts
    assert fim.transform_batch([], [])["n"].tolist() == [] and len(fim.restore_batch([], [])[1]) == 1


def test_rows(docs, empty, spark):
    extra = docs.unionByName(spark.createDataFrame([(None, "a\nb\nc", None, None, None, "x", "y", "z"), (7, None, None, None, None, "x", "y", "z")], docs.schema))
    rows = fim.restore(fim.fill_in_middle(extra)).collect()
    want = [by_hand(r["doc_id"], r["text"] or "") for r in extra.collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted(want, key=repr)
    assert sorted(r["restored"] for r in rows) == sorted(r["text"] or "" for r in extra.collect())
    assert fim.restore(fim.fill_in_middle(empty)).count() == 0
