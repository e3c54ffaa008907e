"""The audit: recipes as published against honest ones, own models, money and the result document."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import knn, leakage, metrics, models, money, recipes, sampling
from tidemark.operators.features import training_table
from tidemark.operators.labels import churn_labels, population
from tidemark.sources.tables import Dataset

MOST_ROWS = 300_000
KEYS = ["msno", "cutoff"]


def profile(ds: Dataset) -> DataFrame:
    return ds.tx.agg(F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"), F.count_distinct("msno").alias("n_users"), F.count("*").alias("n_transactions"))


def pick_cutoffs(data_end: date, n_train: int = 4) -> dict:
    """test: the last month whose labels are settled at the data's end; valid: the last one settled on test; train: those before."""
    test = cal.end_of(data_end)
    while not cal.mature(test, data_end):
        test = cal.shifted(test, -1)
    valid = cal.shifted(test, -1)
    while not cal.mature(valid, test):
        valid = cal.shifted(valid, -1)
    return {"data_end": data_end, "test": test, "valid": valid, "train": [cal.shifted(valid, k) for k in range(-n_train, 0)]}


def _fitted(recipe: recipes.Recipe, train: DataFrame, test: DataFrame, trees: int) -> DataFrame:
    """test with p; both have msno, cutoff, doubles and is_churn."""
    columns = tuple(c for c, kind in train.dtypes if kind == "double")
    if recipe.oversample:
        train = sampling.oversample(train.withColumn("_key", F.xxhash64(*KEYS)), "_key", "is_churn").drop("_key")
    if recipe.model == "knn":
        return _nearest(train, test, columns)
    return models.forest(columns, 2 if recipe.model == "forest_a" else 1, trees).fit(train).predict(test)


def _nearest(train: DataFrame, test: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Medians for nulls, standard scores, then the share of leavers among the nearest."""
    facts = train.agg(*(F.median(c).alias(f"m_{c}") for c in columns)).first().asDict()
    fill = {c: facts[f"m_{c}"] if facts[f"m_{c}"] is not None else 0.0 for c in columns}
    scale = train.na.fill(fill).agg(*(F.avg(c).alias(f"a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first().asDict()
    vector = F.array(*((F.col(c) - (scale[f"a_{c}"] or 0.0)) / (scale[f"s_{c}"] or 1.0) for c in columns))
    # ids of test rows must differ from those of training rows
    of = lambda df, seed: df.na.fill(fill).select(*KEYS, "is_churn", F.xxhash64(*KEYS, F.lit(seed)).alias("id"), vector.alias("v"))
    asked = of(test, 2)
    return test.join(asked.join(knn.rates(asked, of(train, 1), "id", "v", "is_churn"), "id").select(*KEYS, "p"), KEYS)


def _binary(scored: DataFrame) -> dict:
    one = scored.withColumn("_all", F.lit(1))
    row = metrics.ranking(one, ["_all"]).join(metrics.hard(one, ["_all"]), "_all").first()
    return {k: None if row is None or row[k] is None else round(row[k], 4) for k in ("auc", "accuracy", "f1", "precision", "recall")}


def audit_recipe(recipe: recipes.Recipe, ds: Dataset, cut: dict, trees: int = models.FOREST_TREES) -> dict:
    """Scores of a recipe as published, on clean features with the same random split, and honestly in time; and its leaks."""
    test, months = cut["test"], [*cut["train"], cut["valid"]]
    scored = sampling.sample(churn_labels(ds, population(ds, [test])).withColumn("_id", F.xxhash64("msno")), "_id", MOST_ROWS).cache()
    published = recipe.published(ds, scored, [test]).join(scored.select(*KEYS, "is_churn", "_id"), KEYS).cache()
    clean = recipe.honest(ds, scored, [test]).join(scored.select(*KEYS, "is_churn", "_id"), KEYS).cache()
    results = {}
    for name, f in (("as_published", published), ("clean_features_random_split", clean)):
        split = sampling.stratified_split(f, "_id", "is_churn").drop("_id").cache()
        parts = [split.filter(F.col("is_train") == k).drop("is_train") for k in (1, 0)]
        results[name] = _binary(_fitted(recipe, *parts, trees))
    past = churn_labels(ds, population(ds, months))
    past = sampling.sample(past.withColumn("_id", F.xxhash64(*KEYS)), "_id", MOST_ROWS // 4 * len(months)).drop("_id")
    train = recipe.honest(ds, past, months).join(past.select(*KEYS, "is_churn"), KEYS).cache()
    results["honest_time_split"] = _binary(_fitted(recipe, train, clean.drop("_id"), trees))
    names = [c for c, kind in published.dtypes if kind == "double"]
    leaks = leakage.leak_table(leakage.long_form(published, clean, names), scored)
    aucs = results["as_published"]["auc"], results["honest_time_split"]["auc"]
    return {"key": recipe.key, "results": results, "leaks": [r.asDict() for r in leaks.collect()], "auc_drop": None if None in aucs else round(aucs[0] - aucs[1], 4)}


def audit_models(ds: Dataset, cut: dict, a: money.Assumptions, trees: int = models.TREES) -> dict:
    train, valid, test = (training_table(ds, months).cache() for months in (cut["train"], [cut["valid"]], [cut["test"]]))
    on_valid, on_test = (models.fit_predict_all(train, rows, trees=trees) for rows in (valid, test))
    table, best = {}, "boosted"
    for name in on_test:
        v, t = on_valid[name].cache(), on_test[name].cache()
        at = money.best_threshold(v, a).first()["threshold"]
        row = metrics.scores(t, ["cutoff"]).first().asDict()
        row.pop("cutoff")
        table[name] = {**row, "money_threshold": at, "saved_money_threshold": money.savings(t, at, a).first()["saved"], "saved_default_0_5": money.savings(t, 0.5, a).first()["saved"]}
    t = on_test[best]
    hindsight = money.best_threshold(t, a).first()
    chosen = table[best]["money_threshold"]
    return {
        "rows": {"train": train.count(), "valid": valid.count(), "test": test.count()}, "table": table,
        "money": {"model": best, "threshold_chosen_on_validation": chosen, "break_even_chance": round(a.break_even, 4), "comparison": [r.asDict() for r in money.policy_table(t, a, chosen).collect()], "hindsight_best_threshold": hindsight["threshold"], "hindsight_best_saved": hindsight["saved"]},
        "curves": {name: [r.asDict() for r in money.bands(rows[best]).orderBy("band").collect()] for name, rows in (("valid", on_valid), ("test", on_test))},
        "top_features": dict(models.boosted(trees).fit(train).importances()[:10]),
    }


def run(ds: Dataset, a: money.Assumptions, n_train: int = 4, trees: int = models.TREES, forest_trees: int = models.FOREST_TREES) -> dict:
    cut = pick_cutoffs(ds.data_end, n_train)
    return {
        "data": profile(ds).first().asDict(), "cutoffs": cut, "assumptions": vars(a), "recipes": [audit_recipe(r, ds, cut, forest_trees) for r in recipes.RECIPES.values()], "models": audit_models(ds, cut, a, trees),
    }


def save(result: dict, *paths: str | Path) -> None:
    for path in map(Path, paths):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(result, indent=2, default=str))
