"""Periodic runs against a reading of their definition, planted runs and odd rows."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import periodic
from test_llm import DATA, ODD, docs_of, texts


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def plainly(w, least=24):
    """Runs by definition: every stretch that keeps a period to its ends, if that is its smallest one."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(w):
    seen = {}
    return np.array([seen.setdefault(x, len(seen)) for x in w], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_runs_equal_their_definition(data):
    w = data.draw(st.lists(st.integers(0, data.draw(st.sampled_from([0, 1, 2, 5]))), max_size=60))
    for _ in range(data.draw(st.integers(0, 4))):  # repeated stretches, also nested and side by side
        a = data.draw(st.integers(0, len(w)))
        part = w[a : a + data.draw(st.integers(0, 12))] * data.draw(st.integers(1, 7))
        w = w[:a] + part + w[a:]
    w = w[:160]
    for least in (1, 9, 24):
        assert periodic.find_runs(numbered(w), least) == plainly(w, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80))
def test_lag_counts(w):
    codes, n = numbered(w), len(w)
    want = [sum(w[i] == w[i + q] for i in range(n - q)) for q in range(1, n // 3 + 1)]
    assert periodic.lag_counts(codes, n // 3)[1:].tolist() == want
    every = np.arange(codes.max() + 1)
    assert periodic.heavy_lags(codes, every, n // 3)[1:].tolist() == want


def planted(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def digest_row(doc_id, w):
    runs = plainly(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_its_definition(spark):
    want = {i: digest_row(i, planted(i, t)) for i, t in texts() if len((t or "").split()) < 900}
    got = {r[0]: tuple(r) for r in periodic.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(texts()) and len(want) > 100
    assert {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_odd_rows(spark):
    rows = [*ODD, (30, "x " * 24), (31, "x " * 23), (32, "a\x0bb\x1c" * 40), (33, "　 a " * 30)]
    got = sorted(map(str, (tuple(r) for r in periodic.periodic_runs(docs_of(spark, rows)).collect())))
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        if t and len(w) == 30_000:
            runs = [(0, 30_000, 977)]
        else:
            runs = plainly(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want.append(str((i, [f"Row(start={s}, length={m}, period={q})" for s, m, q in runs], best and f"Row(start={best[0]}, length={best[1]}, period={best[2]})", b" ".join(x for k, x in enumerate(w) if k not in gone).decode())).replace("'Row", "Row").replace(")'", ")"))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs_of(spark, [])).collect() == []


def test_long_texts_stay_cheap():
    rng = random.Random(4)
    one, two = np.zeros(300_000, np.int64), np.array([rng.randrange(2) for _ in range(100_000)])
    block = np.array([rng.randrange(1000) for _ in range(400)])
    mixed = np.concatenate([two[:50_000], np.tile(block, 100) + 2, two[50_000:]])
    began = time.process_time()
    assert periodic.find_runs(one) == [(0, 300_000, 1)]
    assert (50_000, 40_000, 400) in periodic.find_runs(mixed)
    assert all(length >= 24 for _, length, _ in periodic.find_runs(two))
    assert time.process_time() - began < 30
