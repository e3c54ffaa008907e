from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import knn


@pytest.mark.parametrize("most", [64 << 20, 1 << 11])
def test_every_training_row_counts(spark, monkeypatch, most):
    """However few rows a block holds, the neighbours are those among all rows, ties and rows of one id included."""
    rng = np.random.default_rng(0)
    ids = [*range(297), 5, 5, 6]
    v = rng.integers(0, 4, (300, 4)).astype(float)
    v[298] = v[297]
    y = rng.integers(0, 2, 300).astype(float)
    rows = [(i, x.tolist(), float(t)) for i, x, t in zip(ids, v, y, strict=True)]
    want = []
    for i, x, _ in rows:
        d = sorted((((v[j] - x) ** 2).sum(), ids[j], y[j]) for j in range(300) if ids[j] != i)
        want.append((i, round(sum(t[2] for t in d[:7]) / 7, 9)))
    monkeypatch.setattr(knn, "MOST_BYTES", most)
    monkeypatch.setattr(knn, "MOST_TRAIN", 40, raising=False)
    df = spark.createDataFrame(rows, "id long, v array<double>, y double")
    got = knn.rates(df, df, "id", "v", "y", 7).collect()
    assert sorted((r.id, round(r.p, 9)) for r in got) == sorted(want)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0)], "id long, v array<double>, y double")
    assert [(r.id, r.p) for r in knn.rates(df, df.limit(0), "id", "v", "y").collect()] == [(1, None)]
    assert [(r.id, r.p) for r in knn.rates(df, df, "id", "v", "y").collect()] == [(1, None)]
