"""Forests against pyspark.ml's trees, and in several layouts of the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tests.test_trees import COLUMNS, by_user, rows, vectors  # noqa: F401
from tidemark.operators import forest, models, trees


def test_a_tree_is_that_of_pyspark(spark, rows):
    v = vectors(rows, False).collect()
    edges = trees.cuts(vectors(rows, False), [0] * 3)
    x, y = trees.binned(pa.array([r.v for r in v]), edges), np.array([int(r.label) for r in v])
    how = forest.Growing(1, 7, 3, 3, 0)
    names = ("places", "feature", "bin", "p")
    made = forest.grow(x, np.ones(len(y), np.int64), y, 0, 1, how)
    part = {n: a.astype(k).tobytes() for n, a, k in zip(names, made, (np.int32, np.int16, np.int32, float), strict=True)}
    feature, bins, p = forest.whole_tree([part], how.depth)
    mine = p[forest._routed(x, feature, bins)]
    data = spark.createDataFrame([(r.v, r.label) for r in v], "v array<double>, label double").withColumn("features", array_to_vector("v"))
    theirs = DecisionTreeClassifier(maxDepth=7, minInstancesPerNode=3, maxBins=256).fit(data)
    other = np.array([r[0][1] for r in theirs.transform(data).select("probability").collect()])
    # equal gains may be split in another way
    assert (np.abs(mine - other) > 1e-9).mean() < 0.01 and theirs.numNodes == 2 * (feature >= 0).sum() + 1 > 50


def test_a_forest_is_alike_in_every_layout(spark, rows):
    """pyspark.ml draws rows by their partition."""
    one, other = (by_user(models.forest(COLUMNS, trees=20).fit(r).predict(rows)) for r in (rows.coalesce(1), rows.repartition(9)))
    assert one == other and len(one) == 1500 and len(set(one.values())) > 300


def test_nodes_of_many_rows_are_split_by_all_tasks(spark, rows):
    v = vectors(rows, False).union(vectors(rows, False).filter("id % 3 = 0"))
    found = []
    for big in (10**9, 150):
        how = forest.Growing(10, 12, 1, 2, 1, big)
        parts, edges = forest.forest_parts(v, how)
        parts = parts.cache()
        found.append({bytes(r.x): r.p for r in forest.forest_shares(forest.with_bins(v, edges), parts, how, 3).collect()})
    assert found[0] == found[1] and parts.count() > 60


def test_a_forest_ranks_leavers_first(spark, rows):
    test = models.forest(COLUMNS, 20, trees=40).fit(rows).predict(rows.withColumn("b", F.when(F.col("a") < 39, F.col("b"))))
    r = test.agg(F.corr("p", "is_churn").alias("c"), F.avg("p").alias("p"), F.avg("is_churn").alias("y"), F.count("*").alias("n")).first()
    assert r.c > 0.3 and abs(r.p - r.y) < 0.03 and r.n == 1500
