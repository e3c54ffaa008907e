"""Hand-worked examples, and the rule that no feature sees past its cut-off."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import clean, drift, features, labels, leakage, metrics, models, money, recipes, sampling
from tidemark.operators.asof import AsOf, visible
from tidemark.plans import audit
from tidemark.sources import raw, synth
from tidemark.sources.tables import Dataset

CUTS = [date(2016, 3, 31), date(2016, 8, 31), date(2016, 11, 30), date(2017, 1, 31)]


@pytest.fixture(scope="module")
def ds(spark, tmp_path_factory):
    """Made-up customers through the real path: CSV files, preparation, Parquet."""
    folder = tmp_path_factory.mktemp("sample")
    synth.write_sample(spark, f"{folder}/raw", 1200, 11)
    raw.prepare(spark, f"{folder}/raw", f"{folder}/prepared")
    return raw.load(spark, f"{folder}/prepared")


def scrambled(ds, cutoff, spark):
    """The same past and another future: changed rows, a cancel for everyone, other listening."""
    c = F.lit(cutoff)
    later = F.col("transaction_date") > c
    tx = ds.tx.withColumns({
        "actual_amount_paid": F.when(later, F.col("actual_amount_paid") + 777).otherwise(F.col("actual_amount_paid")), "is_cancel": F.when(later, 1 - F.col("is_cancel")).otherwise(F.col("is_cancel")),
        "membership_expire_date": F.when(later, F.date_add("membership_expire_date", 400)).otherwise(F.col("membership_expire_date")),
    })
    day = F.date_add(c, 1)
    fake = ds.tx.select("msno").distinct().select("msno", *(F.lit(v).cast("int").alias(k) for k, v in (("payment_method_id", 99), ("payment_plan_days", 999), ("plan_list_price", 1), ("actual_amount_paid", 1), ("is_auto_renew", 0))), day.alias("transaction_date"), F.date_add(c, 900).alias("membership_expire_date"), F.lit(1).alias("is_cancel"), F.xxhash64("msno").alias("tx_id"))
    logs = ds.logs
    for x in (*clean.LOG_SUMS, "days_active"):
        logs = logs.withColumn(x, F.when(F.col("month_end") > c, F.col(x) * 50 + 7).otherwise(F.col(x)))
    return Dataset(tx.unionByName(fake.select(tx.columns)), ds.members, logs)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_calendar(spark):
    assert cal.shifted(date(2017, 2, 28), 1) == date(2017, 3, 31) and cal.known_on(date(2017, 1, 31)) == date(2017, 3, 30)
    assert audit.pick_cutoffs(date(2017, 3, 31)) == {"data_end": date(2017, 3, 31), "test": date(2017, 1, 31), "valid": date(2016, 11, 30), "train": [date(2016, m, d) for m, d in ((7, 31), (8, 31), (9, 30), (10, 31))]}
    days = [date(2016, 1, 1) + timedelta(days=7 * i) for i in range(120)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", cal.month_end(F.col("d")), cal.shift_months(F.col("d"), -3), cal.label_known_on(F.col("d")), cal.is_mature(F.col("d"), F.lit(date(2017, 6, 1))), cal.month_ends_between(F.lit(days[0]), F.col("d"))).collect()
    for d, end, back, known, ripe, ends in rows:
        assert (end, back, known, ripe, ends) == (cal.end_of(d), cal.shifted(d, -3), cal.known_on(d), cal.mature(d, date(2017, 6, 1)), cal.ends_between(days[0], d))


def test_labels_by_hand(spark):
    rows = [("A", "01-15", "02-15", 0), ("A", "02-20", "03-20", 0), ("B", "01-10", "02-10", 0), ("B", "03-20", "04-20", 0), ("C", "01-05", "02-05", 0), ("D", "01-20", "02-20", 0), ("D", "02-10", "02-20", 1)]
    tx = spark.createDataFrame([(m, date.fromisoformat(f"2016-{a}"), date.fromisoformat(f"2016-{b}"), c, i) for i, (m, a, b, c) in enumerate(rows)], "msno string, transaction_date date, membership_expire_date date, is_cancel int, tx_id long")
    ds = Dataset(tx, None, None)
    out = labels.churn_labels(ds, labels.population(ds, [date(2016, 1, 31)]))
    assert {r.msno: r.is_churn for r in out.collect()} == {"A": 0, "B": 1, "C": 1, "D": 1}


def test_listening_is_per_calendar_day(spark):
    days = [(date(2017, 1, 1) + timedelta(days=i)) for i in range(59)]
    daily = spark.createDataFrame([("u", d, 1, 0, 0, 0, 9, 10, 3600.0) for d in days], "msno string, date date, num_25 long, num_50 long, num_75 long, num_985 long, num_100 long, num_unq long, total_secs double")
    tx = spark.createDataFrame([("u", 1, 30, 1, 1, 1, date(2016, 12, 20), date(2017, 3, 20), 0, 1)], "msno string, payment_method_id int, payment_plan_days int, plan_list_price int, actual_amount_paid int, is_auto_renew int, transaction_date date, membership_expire_date date, is_cancel int, tx_id long")
    members = spark.createDataFrame([("u", 1, 20, "male", 7, None)], "msno string, city int, bd int, gender string, registered_via int, registration_init_time date")
    ds, cuts = Dataset(tx, members, clean.monthly_logs(daily)), [date(2017, 1, 31), date(2017, 2, 28)]
    scored = spark.createDataFrame([("u", c) for c in cuts], "msno string, cutoff date")
    for r in features.build(ds, scored, cuts).collect():
        assert (r.days_active_m1, r.secs_m1, r.unique_songs_m1, r.completion_ratio, r.reg_days, r.months_since_active) == (1.0, 3600.0, 10.0, 0.9, None, 0.0)


def test_cleaning(spark):
    tx = [("u", "41", "30", "149", "x", None, "20160101", "20160131", "0")] * 2 + [("u", "41", "30", "149", "1", "1", "20170230", "20160131", "0"), (None, "1", "1", "1", "1", "1", "20160101", "20160131", "0")]
    schema = "msno string, payment_method_id string, payment_plan_days string, plan_list_price string, actual_amount_paid string, is_auto_renew string, transaction_date string, membership_expire_date string, is_cancel string"
    assert [r[:9] for r in clean.clean_tx(spark.createDataFrame(tx, schema)).collect()] == [("u", 41, 30, 149, 0, 0, date(2016, 1, 1), date(2016, 1, 31), 0)]
    secs = spark.createDataFrame([(-5.0,), (None,), (90000.0,), (7.0,)], "s double").select(clean.clip_seconds(F.col("s"))).collect()
    assert [r[0] for r in secs] == [0.0, None, 86400.0, 7.0]


def test_data_rules(ds):
    t = features.training_table(ds, CUTS).cache()
    assert t.groupBy("msno", "cutoff").count().filter("count > 1").isEmpty()
    assert t.filter((F.col("expire_date") <= F.col("cutoff")) | (F.col("expire_date") > cal.shift_months(F.col("cutoff"), 1))).isEmpty()
    rates = {r.cutoff: r.churn_rate for r in labels.churn_rate(t).collect()}
    assert set(rates) == set(CUTS) and all(0.02 < x < 0.4 for x in rates.values())
    assert set(t.columns) == {*features.KEYS, *features.FEATURES, "expire_date", "is_churn"} and len(features.FEATURES) == 31
    seen = visible(ds, CUTS[1])
    assert seen.tx.agg(F.max("transaction_date")).first()[0] <= CUTS[1] and seen.logs.agg(F.max("month_end")).first()[0] <= CUTS[1]


def test_features_never_see_the_future(ds, spark):
    for cutoff in CUTS[1:3]:
        other = scrambled(ds, cutoff, spark)
        assert same(labels.population(ds, [cutoff]), labels.population(other, [cutoff]))
        scored = labels.population(ds, [cutoff]).cache()
        assert same(features.build(ds, scored, [cutoff]), features.build(other, scored, [cutoff]))
        for r in recipes.RECIPES.values():
            assert same(r.honest(ds, scored, [cutoff]), r.honest(other, scored, [cutoff]))
            assert not same(r.published(ds, scored, [cutoff]), r.published(other, scored, [cutoff]))


def test_many_cutoffs_at_once_equal_one_at_a_time(ds):
    scored = labels.population(ds, CUTS)
    together = features.build(ds, scored, CUTS).filter(F.col("cutoff") == F.lit(CUTS[1]))
    assert same(together, features.build(ds, scored.filter(F.col("cutoff") == F.lit(CUTS[1])), [CUTS[1]]))


def test_every_scan_of_history_is_filtered_by_day(ds):
    plan = features.build(ds, labels.population(ds, CUTS[:1]), CUTS[:1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transaction_date") and "Join Cross" not in plan
    physical = features.build(ds, labels.population(ds, CUTS[:1]), CUTS[:1])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in physical.splitlines() if "FileScan parquet" in line and "transactions" in line]
    assert scans and all("LessThanOrEqual(transaction_date" in line for line in scans) and "CartesianProduct" not in physical


def test_money_by_hand(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0], [0.9, 0.8, 0.3, 0.1])), "is_churn int, p double")
    a = money.Assumptions()
    saved = lambda t, a=a: money.savings(df, t, a).first().saved
    assert [saved(t) for t in (0.5, 0.2, 0.05, 0.95)] == [50, 105, 100, 0] and saved(0.5, money.Assumptions(save_rate=0.5)) == 20
    best = money.best_threshold(df, a).first()
    assert 0.1 < best.threshold <= 0.3 and best.saved == 105 and round(a.break_even, 4) == 0.0833
    assert {r.policy: (r.offers, r.leavers_reached) for r in money.policy_table(df, a, 0.2).collect()} == {"money_threshold": (3, 2), "default_0_5": (2, 1), "everyone": (4, 2), "nobody": (0, 0)}


def test_sweep_meets_thresholds_exactly(spark):
    values = [i / 100 for i in range(0, 101)] + [0.285, 0.999, 0.0, 1.0]
    df = spark.createDataFrame([(i % 2, p) for i, p in enumerate(values)], "is_churn int, p double")
    curve = {round(r.threshold * 100): r.offers for r in money.savings_curve(df, money.Assumptions()).collect()}
    assert curve == {k: sum(p >= k / 100 for p in values) for k in range(1, 100)}


def test_bands_reproduce_savings(spark):
    df = spark.range(3000).select(F.rand(3).alias("p"), F.rand(4).alias("u")).select("p", (F.col("u") < F.col("p")).cast("int").alias("is_churn")).cache()
    for n in (5, 20, 50):
        for r in money.calculator(money.bands(df, n), money.Assumptions(), n).collect():
            assert r.saved == money.savings(df, r.threshold, money.Assumptions()).first().saved


def test_exact_metrics(spark):
    import random

    rng = random.Random(1)
    rows = [(g, rng.randrange(20) / 20, int(rng.random() < 0.4)) for g in "ab" for _ in range(150)] + [("c", 0.5, 1), ("c", 0.2, 1)]
    out = {r.g: r for r in metrics.scores(spark.createDataFrame(rows, "g string, p double, is_churn int"), ["g"]).collect()}
    assert out["c"].auc is None and out["c"].log_loss is None and out["c"].n == 2
    for g in "ab":
        own = [(p, y) for k, p, y in rows if k == g]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        assert abs(out[g].auc - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12
        ap = last = 0.0
        for t in sorted({p for p, _ in own}, reverse=True):
            tp, n = sum(p >= t for p in pos), sum(p >= t for p, _ in own)
            ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
        assert abs(out[g].ap - ap) < 1e-12


def test_closeness_follows_the_tolerance(spark):
    pairs = [(20170131.0, 20170331.0, True), (20161231.0, 20170131.0, False), (None, None, True), (None, 1.0, False), (0.0, 1e-9, True)]
    rows = spark.createDataFrame(pairs, "a double, b double, want boolean").select("want", leakage.is_close(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_constant_feature_has_no_drift(spark):
    base = {f: 1.0 for f in drift.NUMERIC}
    make = lambda age, method: spark.createDataFrame([{**base, "age": float(a), "payment_method": method} for a in age])
    out = {r.feature: r.psi for r in drift.report(make(range(20, 60), "41"), make(range(40, 80), "34")).collect()}
    assert out["auto_renew"] == 0.0 and out["age"] > 1 and out["payment_method"] > 1


def test_samples(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert sampling.sample(df, "id", 77).count() == 77 and same(sampling.sample(df, "id", 77), sampling.sample(df.repartition(7), "id", 77))
    split = {(r.y, r.is_train): r["count"] for r in sampling.stratified_split(df, "id", "y").groupBy("y", "is_train").count().collect()}
    assert split == {(0, 1): 630, (0, 0): 270, (1, 1): 70, (1, 0): 30}
    more = {r.y: (r.n, r.k) for r in sampling.oversample(df, "id", "y").groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).collect()}
    assert more == {0: (900, 900), 1: (900, 100)}


def test_models_beat_the_constant(ds):
    train = features.training_table(ds, [date(2016, m, d) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))]).cache()
    test = features.training_table(ds, [date(2016, 6, 30)]).cache()
    auc = {name: metrics.ranking(p, ["cutoff"]).first().auc for name, p in models.fit_predict_all(train, test, trees=30).items()}
    assert auc["nobody_churns"] == 0.5 and auc["logistic"] > 0.62 and auc["boosted"] > 0.62 and auc["auto_renew_rule"] > 0.55


def test_a_user_of_several_ties_has_one_last_row(ds):
    last = AsOf(ds, tuple(CUTS)).last_tx()
    assert last.groupBy("msno", "cutoff").count().filter("count > 1").isEmpty()
