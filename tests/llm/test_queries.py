"""Registered queries against their SQL, and the pipeline's stages one by one."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as C
from tallyfold.llm import kneser_ney as model
from tallyfold.llm.common import keep, table
from tallyfold.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from ..conftest import DATA, rows
from .brute import grams_of, kneser_ney


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())


def ids(df) -> list:
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda d: (d is None, d))


def by_sql(name: str, docs) -> dict[int, dict]:
    """Rows of a query's SQL over a stage's input, by doc_id."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return {r["doc_id"]: r for r in con.execute(ORACLE_SQL[name]).fetchdf().to_dict("records")}


def classified(docs, trusted: set[int]) -> set[int]:
    """doc_ids the classifier keeps, by brute force."""
    rows = docs.collect()
    kept = {r["doc_id"] for r in rows}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        good = [r for r in own if r["doc_id"] in trusted]
        signed = lambda text: (xxhash.xxh64_intdigest(text.encode(), 42) ^ (1 << 63)) - (1 << 63)
        out = {r["doc_id"] for r in good if signed(r["text"]) % model.HELD_OUT == 0}
        p = kneser_ney([r["text"] or "" for r in good if r["doc_id"] not in out])
        costs = {r["doc_id"]: (sum(math.floor(-math.log(p(g)) * model.UNIT + 0.5) for g in grams), len(grams)) for r in own if (grams := grams_of(r["text"] or ""))}
        held = [costs[d] for d in out if d in costs]
        if not held:
            continue
        mean = sum(c for c, _ in held) / sum(n for _, n in held)
        rate = lambda c, n: math.floor((c + model.PRIOR * mean) / (n + model.PRIOR) / model.UNIT * model.RATES + 0.5)
        rates = sorted(rate(*x) for x in held)
        limit = max(rates[math.ceil(model.QUANTILE * len(rates)) - 1], math.floor(np.mean(rates) + model.DEVIATIONS * np.std(rates) + 0.5))
        kept -= {d for d, x in costs.items() if rate(*x) > limit}
    return kept


def test_pipeline_by_brute_force(spark):
    """Every stage on what its predecessor kept: SQL, or plain Python where SQL can't say it."""
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0")
    kept = [docs]
    for _, stage in C.STAGES:
        kept.append(keep(stage(spark, kept[-1], DATA), "test"))
    assert all(df.columns == docs.columns for df in kept[:-1])
    assert ids(kept[1]) == sorted(d for d, r in by_sql("op5_quality_divergence", kept[0]).items() if r["kept"])
    assert ids(kept[2]) == sorted(classified(kept[1], {r["doc_id"] for r in labels.collect()}))
    assert ids(kept[3]) == sorted(d for d, r in by_sql("op9_setsketch_dedup", kept[2]).items() if r["kept"])
    copies = {d: r["taken"] // r["size"] for d, r in by_sql("op8_pareto_mixing", kept[3]).items()}
    assert ids(kept[4]) == sorted(d for d, n in copies.items() for _ in range(int(n)))
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in kept[4].collect():
        own = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], i, at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096].tobytes())) for i, at in enumerate(range(0, len(own), 4096))]
    pieces = kept[5].collect()
    assert sorted(tuple(r)[:5] for r in pieces) == sorted(want)
    places: dict = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *parts], parts)) and sum(n for _, n in parts) <= 4096
    assert len(places) <= 1.05 * sum(w[3] for w in want) / 4096 + 1


def test_pipeline_odd_rows(spark):
    """Nulls in every column, repeated rows, clashing extra columns and empty tables pass every stage."""
    docs = table(spark, DATA, "documents")
    extra = docs.select("*", *[docs["source"].alias(c) for c in ("_id", "kept", "key", "pref", "size", "rank", "odds", "copies", "trusted", "_slice")])
    nothing = spark.range(3).selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in extra.dtypes])
    whole = extra.unionByName(extra.limit(5)).unionByName(nothing)
    for start, empty in ((whole, False), (whole.limit(0), True)):
        rows_in = start
        for name, stage in C.STAGES:
            out = keep(stage(spark, rows_in, DATA), "test")
            n = out.count()
            assert n == 0 if empty else n > 0, name
            if name != C.STAGES[-1][0]:
                assert out.columns == start.columns, name
                assert set(ids(out)) <= set(ids(rows_in)), name
                rows_in = out
