"""Histogram boosting against a plain NumPy version."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from crosspanel.operators import boosting as bo


def grown(x, residual, depth, least, penalty, rate, width):
    """One tree as a function of rows of bins, built by looking at every split of every node."""
    n, total = len(residual), residual.sum()
    leaf = rate * total / (n + penalty)
    best, at = 1e-12, None
    for f in range(x.shape[1]) if depth else ():
        for cut in range(width):
            left = x[:, f] <= cut
            k = int(left.sum())
            if k < least or n - k < least:
                continue
            gain = residual[left].sum() ** 2 / (k + penalty) + residual[~left].sum() ** 2 / (n - k + penalty) - total**2 / (n + penalty)
            if round(gain, 12) > best:
                best, at = round(gain, 12), (f, cut)
    if at is None:
        return lambda rows: np.full(len(rows), leaf)
    f, cut = at
    left = x[:, f] <= cut
    low, high = (grown(x[m], residual[m], depth - 1, least, penalty, rate, width) for m in (left, ~left))
    return lambda rows: np.where(rows[:, f] <= cut, low(rows), high(rows))


def test_boosting_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(bo, "KEPT_ROUNDS", 4)
    draw = np.random.default_rng(4)
    n, rounds, depth = 600, 6, 3
    x = draw.normal(size=(n, 3)).round(2)
    fold = draw.integers(0, 2, n)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + draw.normal(size=n) * 0.1
    rows = [(int(f), *map(float, r), float(t)) for f, r, t in zip(fold, x, y, strict=True)] + [(0, None, 1.0, 1.0, 9.0), (1, 0.1, 0.1, 0.1, None)]
    frame = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double").repartition(5)
    models, edges = bo.train(frame, "fold", ["a", "b", "c"], "y", depth, rounds, 0.3, 16, 1.0, 10)
    bins = np.column_stack([(x[:, [i]] > np.array(e)[None, :]).sum(axis=1) for i, e in enumerate(edges)])
    assert all(5 < len(e) < 16 for e in edges) and sorted(models) == [0, 1]
    want = np.zeros(n)
    for f in (0, 1):
        mine = fold == f
        score = np.full(mine.sum(), y[mine].mean())
        for _ in range(rounds):
            score += grown(bins[mine], y[mine] - score, depth, 10, 1.0, 0.3, 16)(bins[mine])
        want[mine] = score
    got = bo.scored(frame, models, edges, "fold", ["a", "b", "c"]).where("a IS NOT NULL AND y IS NOT NULL").select("y", "score").collect()
    expected = dict(zip(y.tolist(), want.tolist(), strict=True))
    assert len(got) == n and np.allclose([r.score for r in got], [expected[r.y] for r in got])
    assert np.mean((want - y) ** 2) < 0.3 * np.var(y)
    odd = bo.scored(spark.createDataFrame([(0, None, 1.0, 1.0, 1.0), (7, 1.0, 1.0, 1.0, 1.0)], frame.schema), models, edges, "fold", ["a", "b", "c"])
    assert [r.score for r in odd.collect()] == [None, None]
    assert bo.train(frame.where(F.lit(False)), "fold", ["a", "b", "c"], "y", 2, 1)[0] == {}
