"""Longest common extensions and runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from anualia.llm import periodic_runs, queries
from anualia.llm.common_extensions import COVER, MODULUS, Extensions

from .conftest import frame, odd_rows


def test_cover_has_every_difference_once():
    found = Counter((int(a) - int(b)) % MODULUS for a in COVER for b in COVER)
    assert set(found) == set(range(MODULUS)) and all(n == 1 for d, n in found.items() if d)


def brute_extension(w, i, j):
    n = 0
    while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(1, 150))
def test_extensions(seed, letters, n):
    rng = np.random.default_rng(seed)
    w = np.append(rng.integers(0, letters, n), letters)
    if seed % 3 == 0:
        w[:n] = np.resize(w[: seed % 17 + 1], n)
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    i, j = i[i != j], j[i != j]
    assert Extensions(w)(i, j).tolist() == [brute_extension(w, a, b) for a, b in zip(i.tolist(), j.tolist())]


def brute_runs(w, least=12):
    """All runs by definition: for each period the stretches that keep it, if it is their smallest."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            stop = at
            while stop + q < len(w) and w[stop] == w[stop + q]:
                stop += 1
            length = stop - at + q
            if length >= max(least, 2 * q):
                best.setdefault((at, stop + q), q)
            at = stop
    return sorted((a, b - a, q) for (a, b), q in best.items())


def found_runs(texts):
    numbers = {}
    ids = np.array([numbers.setdefault(x, len(numbers)) for t in texts for x in t], np.int64)
    text, *rest = periodic_runs.find_runs(ids, np.array([len(t) for t in texts], np.int64))
    return [[tuple(int(c[k]) for c in rest) for k in np.flatnonzero(text == t)] for t in range(len(texts))]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_of_special_words():
    texts = [
        [], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 6, ["a", "b"] * 5, list("abcdef") * 2, list("abcdefg") * 2, ["a"] * 500,
        fibonacci(400), list("xaaaaaaaaaaaaay") + list("abc" * 9) + ["z"], list("abcab" * 7 + "abc" + "q" + "abcab" * 7),
    ]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 6)):
        t = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            t += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] * rng.randint(2, 4)
        texts.append(t)
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_passages_that_texts_share():
    """Equal words of two texts on the grid are no run, wherever the texts lie."""
    rng = random.Random(0)
    passage = [f"p{k}" for k in range(40)]
    for n in range(60):
        texts = [[f"{t}-{k}" for k in range(rng.randint(0, 120))] + passage + [f"{t}+{k}" for k in range(rng.randint(0, 90))] for t in range(6)]
        texts.append(list("abc" * rng.randint(4, 9)))
        assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_pairs_in_slices(monkeypatch):
    texts = [fibonacci(300), ["a"] * 200, list("abcd" * 40)]
    want = [brute_runs(t) for t in texts]
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 7)
    assert found_runs(texts) == want


def brute(rows):
    out = Counter()
    for i, text in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = brute_runs(w)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out[
            i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in dropped)).hexdigest(),
        ] += 1
    return out


def measured(spark, path):
    return Counter(map(tuple, queries.op11_periodic_runs(spark, str(path)).collect()))


def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert measured(spark, tmp_path) == want and sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark, tmp_path):
    rows = [r for r in odd_rows() if not r[1] or len(r[1]) < 50_000]
    rows += [(10 * k + 100, ("alpha beta  gamma\tdelta " * k)[: 40 * k], "en", "a") for k in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert measured(spark, tmp_path / "a") == brute([(r[0], r[1]) for r in rows])
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert measured(spark, tmp_path / "b") == Counter()


def test_a_very_long_text(spark):
    base = [f"w{k}" for k in range(50_000)]
    text = " ".join(base + base + ["x"] * 40_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = periodic_runs.measure(df, ("doc_id",)).collect()
    assert [tuple(r) for r in row.runs] == [(0, 100_000, 50_000), (100_000, 40_000, 1)]
    assert row.kept == " ".join([*base, "x"]) and row.n_words == 140_000


@pytest.mark.parametrize("n", [0, 1])
def test_texts_without_words(n):
    assert found_runs([[]] * n) == [[]] * n
