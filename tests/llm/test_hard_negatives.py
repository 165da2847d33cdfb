"""Strassen products, heaps and mined negatives against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anualia.llm import hard_negatives, queries
from anualia.llm.strassen import multiply


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 40), (64, 64, 64), (65, 70, 129), (0, 5, 3), (40, 0, 40)])
@pytest.mark.parametrize("top", [3, 1 << 10, 1 << 28])
def test_products_are_exact(shape, top):
    rng = np.random.default_rng(sum(shape) + top)
    m, k, n = shape
    a, b = rng.integers(-top, top + 1, (m, k)), rng.integers(-top, top + 1, (k, n))
    want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), np.int64)
    assert (multiply(a, b) == want).all() and multiply(a, b).shape == (m, n)


def test_an_inner_side_that_differs_is_padded():
    a, b = np.arange(60).reshape(20, 3), np.arange(40).reshape(2, 20)
    assert (multiply(a, b) == a[:, :2] @ b).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 5), st.integers(0, 99)), max_size=60), st.integers(1, 9))
def test_heaps_merge_in_any_parts(rows, parts):
    heaps = hard_negatives.Heaps(4, 3)
    rows = [(s, v, i, n) for n, (s, v, i, _) in enumerate(rows)]
    for at in range(0, len(rows), parts):
        heaps.offer(*(np.array(x, np.int64) for x in zip(*rows[at : at + parts])))
    want = {(s, v, i, n) for k in range(4) for s, v, i, n in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3]))[:3]}
    assert set(zip(*(x.tolist() for x in heaps.entries()))) == want


def brute(rows):
    """Mined negatives of (vec_id, vector, label) rows, one anchor at a time."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [min(max(math.floor(256 * float(np.float32(x))), -(1 << 28)), 1 << 28) for x in v], label))
    out = Counter()
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), math.inf if j is None else j, other) for c, (j, w, other) in enumerate(kept) if c != a]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in order if s[2] == label][:5]:
            fits = [s for s in order if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            for rank, (ns, nid, _) in enumerate(fits, 1):
                out[i, None if pid == math.inf else pid, rank, None if nid == math.inf else nid, ps, ns] += 1
    return out


SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("row", "id", "score", "slot", "rank", "vector", "is_anchor", "block")],
])


def mined(spark, tmp_path, rows):
    spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return Counter(map(tuple, got.collect()))


def test_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) + (i % 3 == j) for j in range(7)], rng.randrange(10)) for i in range(700)]
    want = brute(rows)
    assert len(want) > 300 and mined(spark, tmp_path / "a", rows) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 2)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    assert mined(spark, tmp_path / "b", rows) == want


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    base = [round(rng.uniform(-1, 1), 2) for _ in range(5)]
    rows = [
        (0, base, 1), (0, base, 1), (100, base, 1), (200, None, 1), (300, base, None), (400, [1.0, None], 1),
        (500, [float("nan")] * 5, 1), (600, [float("inf"), 0.0], 2), (700, [], 3), (800, [0.0] * 5, 4), (None, base, 1), (None, base, 2),
        (-100, [-x for x in base], 1), (900, [3e38, 1.0], 5), (901, [1e30, 1.0], 5), (1000, [1.0], 6), (1001, [0.5, 2.0, 1.0], 6),
        *[(1100 + k, base, k % 4) for k in range(40)],  # ties
        *[(2000 + k, [x * rng.uniform(0, 1) for x in base], rng.randrange(10)) for k in range(300)],
    ]
    got = mined(spark, tmp_path / "odd", rows)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, tmp_path / "none", []) == Counter()
    assert mined(spark, tmp_path / "lone", [(100, base, 1), (201, base, 2)]) == Counter()


def test_window_bounds():
    scores = np.array([-7, -1, 0, 1, 2, 3, 9, 10, 11, 99, 100, 101, 12345, (1 << 62) + 12345])
    low, high = hard_negatives._window(scores, 30, 90)
    for s, a, b in zip(scores.tolist(), low.tolist(), high.tolist()):
        assert a == -(-30 * s // 100) and b == 90 * s // 100


def test_anchor_is_any_condition(spark):
    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") == 8, positives=2, negatives=3, low=0, high=100)
    assert {r.anchor_id for r in got.collect()} == {8} and got.count() == 6
