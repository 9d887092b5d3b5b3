"""Compressed sets of ids against Python's sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyfold.functions import containers as K
from tallyfold.operators import coverage as C


def shapes() -> list[list[int]]:
    r = random.Random(3)
    full = list(range(1 << 16))
    return [[], [0], [65535], full, full[::2], full[100:40_000], sorted(r.sample(full, 300)), sorted(r.sample(full, 30_000)), sorted({x for a in r.sample(full[:-200], 40) for x in range(a, a + 150)}), full[:-1]]


def test_forms():
    for values in shapes():
        packed = K.pack(np.array(values, np.int64))
        assert K.unpack(packed).tolist() == values
        assert len(packed) <= 1 + min(2 * len(values), 8192)
    assert [K.pack(np.array(v))[0] for v in ([5], range(65536), range(0, 65536, 2))] == [K.ARRAY, K.RUNS, K.BITMAP]
    assert len(K.pack(np.arange(65536))) == 5 and K.unpack(None).tolist() == []


def test_algebra():
    probe = np.array([0, 1, 2, 99, 100, 39_999, 40_000, 65_534, 65_535])
    for a in shapes()[1:]:
        x = K.pack(np.array(a, np.int64))
        assert K.holds(x, probe).tolist() == [p in set(a) for p in probe.tolist()]
        for b in shapes()[1:]:
            y = K.pack(np.array(b, np.int64))
            assert set(K.unpack(K.merged(x, y)).tolist()) == set(a) | set(b)
            assert set(K.unpack(K.less(x, y)).tolist()) == set(a) - set(b)
            assert set(K.unpack(K.common(x, y)).tolist()) == set(a) & set(b)
    assert not K.holds(None, probe).any() and K.less(x, x) is None and K.common(x, None) is None


@pytest.fixture(scope="module")
def ids():
    r = random.Random(8)
    sparse = [r.randrange(-(2**62), 2**62) for _ in range(4000)]
    return sparse[:3000] + list(range(70_000, 80_000)) + [5, 5, 5], sparse[1000:] + list(range(75_000, 90_000)) + [6]


def test_sets_of_ids(spark, ids):
    a, b = (spark.createDataFrame([(i,) for i in some] + [(None,)], "id long").repartition(5) for some in ids)
    x, y = C.id_containers(a), C.id_containers(b)
    rows = lambda df: sorted(r["id"] for r in C.ids_of(df).collect())
    assert rows(x) == sorted(set(ids[0])) and rows(C.sets_less(x, y)) == sorted(set(ids[0]) - set(ids[1]))
    assert rows(C.sets_common(x, y)) == sorted(set(ids[0]) & set(ids[1])) and rows(C.missing_in_sets(x, y, x)) == []
    assert sum(r["n"] for r in x.collect()) == len(set(ids[0]))
    assert C.id_containers(a.limit(0)).count() == 0


def test_bytes_of_an_id(spark):
    """Spread over 64 bits an id takes three bytes and its chunk's number; a fixed bitmap a bucket takes 4,096."""
    sparse = spark.range(20_000).selectExpr("id * 1000000007 as id")
    held = C.id_containers(sparse).selectExpr("sum(length(container)) as b", "count(*) as chunks").first()
    assert held["b"] == 3 * 20_000 and held["chunks"] == 20_000
    dense = C.id_containers(spark.range(1 << 20)).selectExpr("sum(length(container)) as b").first()
    assert dense["b"] == 5 * 16
