"""Periodic runs against brute force over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=12, times=2):
    codes = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words], int)
    out = {}
    for q in range(1, len(x) // 2 + 1):
        edge = np.diff(np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - s + q >= max(least, times * q):
                out.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    keep = [True] * len(words)
    for s, n, q in runs:
        keep[s + q : s + n] = [False] * (n - q)
    return " ".join(w for w, k in zip(words, keep, strict=True) if k)


def planted_words(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def found(words, **how):
    from gristmill.llm.periodic_runs import find_runs

    codes = {}
    return [tuple(r) for r in find_runs(np.array([codes.setdefault(w, len(codes)) for w in words], np.int64), **how).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_small_alphabets(words):
    assert found(words) == brute(words)
    assert found(words, least=2) == brute(words, least=2)


@pytest.mark.parametrize("seed", range(12))
def test_nested_and_long_periods(seed):
    rng = random.Random(seed)
    unit = [rng.randrange(4) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 6)
    words = [rng.randrange(50) for _ in range(rng.randrange(60))] + unit + [99, *unit, 99, *unit[: len(unit) // 2]] + [7] * rng.randrange(30)
    words += words[: rng.randrange(len(words))]
    assert found(words) == brute(words)
    assert found(words, times=3) == brute(words, times=3)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert found(b) == brute(b)


def test_operator_and_query(spark):
    from gristmill.llm.periodic_runs import periodic_runs, planted, run_digests

    rng = random.Random(2)
    some = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(i, some(rng.randrange(0, 400), rng.choice([3, 40, 4000]))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a " * 5000), (1004, (some(700, 10**6) + "\n") * 3), (1005, "ü ö\x0b" * 30), (3, rows[3][1]), (None, "x y " * 9), (-7, "one"), (1006, "Z" * 70_000 + " b" * 20)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, runs string, start int").repartition(4)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        want.append((i is None, i or 0, brute(w), collapsed(w, brute(w))))
    assert got == sorted(want)

    query = run_digests(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
    assert query.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = planted_words(i, t) if i is not None else WORD.findall(t)
        runs = brute(w)
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs))))
    assert sorted(map(tuple, query.collect()), key=repr) == sorted(want, key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 15
    assert periodic_runs(docs.limit(0)).count() == 0


def test_cost_follows_length():
    """One word a hundred thousand times, and a square of different words: no period costs a pass of its own."""
    n = 100_000
    assert found([1] * n) == [(0, n, 1)]
    assert found(list(range(n // 2)) * 2) == [(0, n, n // 2)]
