from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, rank string, base string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(12_000))


def _texts() -> list[str | None]:
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "in", "is", "that"] + ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    prose = [" ".join(r.choices(vocabulary, k=r.randint(25, 120))).capitalize() + "." for _ in range(40)]
    near = [prose[0] + " tail", prose[0].replace("the", "THE", 1), prose[1] + "\n\nmore words here", prose[0], prose[0]]
    odd = [None, "", " ", "\n\n", "one", "one two three", "Ünï ©ode — ÄÖ ß 日本語   x", "a  b\tc\r\nd", "x " * 400, LONG, "### %%% " * 60, "CAPS!! AND!! MORE!! " * 30]
    return prose + near + odd


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3, t, ["en", "de", None, "xx"][i % 4], ["s1", "s2", None, ""][i % 4 if i % 3 else 0], 1, "clash", "clash", "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows + [rows[3]], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) of every row."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
