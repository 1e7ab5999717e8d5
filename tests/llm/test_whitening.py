"""Whitening against numpy on the whole matrix."""

import math
import random

import numpy as np
import pytest

from relayout.llm import queries, whitening

from .conftest import SF

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows):
    """Rows of (vec_id, vector) as the operator's, by singular values of the whole centred matrix."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    fitted = sorted({tuple(v) for _, v in kept})
    n = len(fitted)
    if not n or not d:
        return []
    s = [sum(column) for column in zip(*fitted)]
    a = np.array([[n * x - t for x, t in zip(v, s)] for v in fitted], np.longdouble) / n
    sizes, right = np.linalg.svd(np.concatenate([a.astype(float), np.zeros((d, d))]))[1:]
    values, vectors = sizes**2 / n, right.T
    out = []
    for i, v in kept:
        exact = [n * x - t for x, t in zip(v, s)]
        deviation = sum(x * x for x in exact)
        row = np.array(exact, np.longdouble) / n
        for m in range(min(4, d)):
            varies = n > 1 and values[m] > values[0] * 1e-24
            white = float(row @ vectors[:, m] / math.sqrt(values[m])) if varies else None
            share = (values[m] / values.sum() if varies else 0.0) if n > 1 else None
            out.append((i, m + 1, n, deviation if deviation < 1 << 63 else None, white, share))
    return out


def compare(got, want, loose=1e-7):
    got = sorted(got, key=lambda r: (r.component, r.vec_id is not None, r.vec_id, r.deviation or 0, abs(r.whitened or 0)))
    want = sorted(want, key=lambda r: (r[1], r[0] is not None, r[0], r[3] or 0, abs(r[4] or 0)))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    for m in {r[1] for r in want}:
        one = np.array([r.whitened for r in got if r.component == m], float)
        two = np.array([r[4] for r in want if r[1] == m], float)
        assert (np.isnan(one) == np.isnan(two)).all()
        one, two = np.nan_to_num(one), np.nan_to_num(two)
        sign = np.sign(one @ two) or 1
        assert np.abs(one * sign - two).max() < loose
        for r in [r for r in got if r.component == m][:1]:
            share = next(w[5] for w in want if w[1] == m)
            assert (r.explained is None) == (share is None) and (not share or abs(r.explained / share - 1) < 1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) <= 1 and all(error is None or error < 1e-9 for error in errors)


def frame(spark, rows):
    extra = [(i, v, "x", b"y", 1, 2.0) for i, v in rows]
    schema = "vec_id long, embedding array<float>, x string, m binary, n int, whitened double"
    return spark.createDataFrame(extra, schema).repartition(3)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = queries.QUERIES["op11_whitening"](spark, SF)
    assert df.columns == NAMES
    compare(df.collect(), brute(rows))


def cases():
    seed = np.random.default_rng(3)
    base = seed.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5]
    odd = [None, [], [1.0, None], [float("nan")] * 6, [float("inf"), 0.0], [0.5], [-0.0] * 6, [0.0] * 6]
    ill = seed.normal(size=(400, 5)) @ np.diag([1e6, 3e4, 900, 20, 0.5]) @ np.linalg.qr(seed.normal(size=(5, 5)))[0]
    return {
        "odd": [*enumerate(base.tolist()), *[(900 + i, v) for i, v in enumerate(odd)], (None, [1.0] * 6), (7, [2.0] * 6)],
        "copies": [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(200)],
        "constant dimensions": [(i, [float(i), 5.0, float(i * i), 5.0, -7.0]) for i in range(40)],
        "fewer vectors than dimensions": [(i, v) for i, v in enumerate((seed.normal(size=(3, 8)) * 3).tolist())],
        "one vector": [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
        "one dimension": [(i, [float(i)]) for i in range(9)],
        "ill conditioned": [(i, v) for i, v in enumerate(ill.tolist())],
        "large mean": [(i, [float(1 << 22) + v[0], v[1] - float(1 << 20)]) for i, v in enumerate(base.tolist())],
        "only empty": [(1, []), (2, None)],
        "none": [],
    }


@pytest.mark.parametrize("name", list(cases()))
def test_cases(spark, name):
    rows = cases()[name]
    read = frame(spark, rows)
    exact = [(r.vec_id, r.embedding) for r in read.collect()]  # as floats
    got = whitening.whiten(read).select(NAMES).collect()
    compare(got, brute(exact), 1e-5 if name == "ill conditioned" else 1e-7)
    if name in ("only empty", "none"):
        assert got == []


def test_exact_deviations_beyond_machine_integers():
    seed = random.Random(8)
    x = np.array([[seed.randint(-(1 << 40), 1 << 40) for _ in range(5)] for _ in range(50)])
    s = tuple(seed.randint(-(1 << 60), 1 << 60) for _ in range(5))
    want = [sum((70_000 * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    assert whitening.small_deviations(x, 70_000, s) == [w if w < 1 << 63 else None for w in want]
    small = x >> 36
    want = [sum((300 * int(a) - 5) ** 2 for a in row) for row in small]
    assert whitening.small_deviations(small, 300, (5,) * 5) == want


def test_entries_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30]), (2, [1.0])])).collect()
