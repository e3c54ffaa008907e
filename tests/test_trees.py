"""Boosted trees against pyspark.ml's, and in several layouts of the rows."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import models, trees

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    made = [(str(i), int(r.integers(0, 40)), int(r.integers(0, 9)), int(r.integers(0, 200)) / 4, int(r.integers(0, 6))) for i in range(1500)]
    leaves = [int(r.random() < 0.15 + 0.5 * (a > 17) * (b % 3 == 0) + 0.25 * (k in (1, 4))) for _, a, b, _, k in made]
    schema = "msno string, a double, b double, c double, k string, is_churn int, cutoff date"
    return spark.createDataFrame([(m, float(a), float(b) if b else None, c, str(k), y, date(2000, 1, 31)) for (m, a, b, c, k), y in zip(made, leaves, strict=True)], schema).cache()


def vectors(rows, categories=True):
    v = [F.coalesce(F.col(c), F.lit(4.0)) for c in COLUMNS] + [F.col("k").cast("double")] * categories
    return rows.select(F.xxhash64("msno").alias("id"), F.col("is_churn").cast("double").alias("label"), F.array(*v).alias("v"))


def by_user(df):
    return {r.msno: round(r.p, 9) for r in df.select("msno", "p").collect()}


def test_boosting_is_that_of_pyspark(spark, rows):
    """Without draws the nodes are pyspark.ml's own."""
    v, how = vectors(rows), trees.Boosting(8, 0.1, 4, 30, 1.0, 1.0, 0)
    nodes, edges = trees.boosted_nodes(v, [0, 0, 0, 6], how)
    mine = trees.gbt_model(spark, nodes, edges, [0, 0, 0, 6], 0.1)
    indexed = StringIndexer(inputCol="k", outputCol="ki", stringOrderType="alphabetAsc").fit(rows).transform(rows.na.fill(4.0))
    data = VectorAssembler(inputCols=[*COLUMNS, "ki"], outputCol="features").transform(indexed).withColumn("label", F.col("is_churn").cast("double")).cache()
    theirs = GBTClassifier(maxIter=8, stepSize=0.1, maxDepth=4, minInstancesPerNode=30, maxBins=256, featureSubsetStrategy="all").fit(data)
    p = [np.array([r[0][1] for r in m.transform(data).select("probability").collect()]) for m in (mine, theirs)]
    assert np.abs(p[0] - p[1]).max() < 1e-6 and p[0].std() > 0.05
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-6)
    assert {n[6] for n in nodes} >= {0, 1, 3}


def test_boosting_is_alike_in_one_task_and_in_several(spark, rows):
    how = trees.Boosting(12, 0.1, 4, 20, 0.8, 0.8, 3)
    one = trees.boosted_nodes(vectors(rows.coalesce(1)), [0, 0, 0, 6], how)[0]
    several = trees.boosted_nodes(vectors(rows.repartition(7)), [0, 0, 0, 6], how, task_rows=400)[0]
    assert one == several and len({n[0] for n in one}) == 12


def test_boosting_takes_few_jobs(spark, rows):
    """By pyspark.ml each level of each tree is a job: 300 trees took over a thousand."""
    spark.sparkContext.setJobGroup("boosted", "boosted")
    try:
        learned = models.boosted()
        learned.numeric, learned.categorical = COLUMNS, ("k",)
        out = learned.fit(rows).predict(rows).cache()
        assert out.count() == 1500
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert learned.model.stages[-1].getNumTrees == 300
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) < 100


def test_a_saved_model_gives_the_same(spark, rows, tmp_path):
    learned = models.boosted(5)
    learned.numeric, learned.categorical = COLUMNS, ("k",)
    before = by_user(learned.fit(rows).predict(rows))
    learned.model.write().overwrite().save(str(tmp_path / "m"))
    learned.model = PipelineModel.load(str(tmp_path / "m"))
    assert by_user(learned.predict(rows)) == before and len(learned.importances()) == 4
