"""The registered queries of the churn audit, and the SQL that gives the same rows.

Every query runs on whole tables of the star schema.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalogue_sql as sql
from tidemark.functions import calendar as cal
from tidemark.operators import clean, drift, features, knn, labels, leakage, metrics, models, money, recipes, sampling
from tidemark.operators.asof import AsOf
from tidemark.plans import audit, replay
from tidemark.sources.tables import Dataset, star, star_daily_logs, star_members, star_tx
from tidemark.streaming import monthly as streams

CUTOFFS = [date(1997, 6, 30), date(1999, 1, 31), date(2000, 12, 31)]
MONEY = money.Assumptions()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, doubles rounded, truth values as integers."""
    def one(c: str, kind: str):
        if kind in ("int", "smallint", "tinyint", "boolean"):
            return F.col(c).cast("int").cast("long").alias(c)
        if kind in ("double", "float") or kind.startswith("decimal"):
            return F.round(F.col(c).cast("double"), 6).alias(c)
        return F.col(c)

    return df.select(*(one(c, kind) for c, kind in df.dtypes))


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# --- calendar ----------------------------------------------------------------------------------------------------


@query(sql.MONTH_ENDS)
def q_month_end_calendar(spark, sf_dir):
    d = star_tx(spark, sf_dir).select(F.col("transaction_date").alias("d")).distinct()
    return d.select("d", cal.month_end(F.col("d")).alias("month_end"), cal.shift_months(F.col("d"), 1).alias("next_end"), cal.shift_months(F.col("d"), -3).alias("end_3_before"), cal.as_number(F.col("d")).alias("as_number"))


@query(sql.KNOWN_ON)
def q_label_known_on(spark, sf_dir):
    return star_tx(spark, sf_dir).select(cal.month_end(F.col("transaction_date")).alias("cutoff")).distinct().withColumn("known_on", cal.label_known_on(F.col("cutoff")))


@query(sql.MATURE)
def q_is_mature(spark, sf_dir):
    tx = star_tx(spark, sf_dir)
    last = tx.agg(F.max("transaction_date").alias("data_end"))
    ends = tx.select(cal.month_end(F.col("transaction_date")).alias("cutoff")).distinct()
    return ends.join(F.broadcast(last)).select("cutoff", cal.is_mature(F.col("cutoff"), F.col("data_end")).alias("mature"))


@query(sql.ENDS_BETWEEN)
def q_month_ends_between(spark, sf_dir):
    span = star_tx(spark, sf_dir).agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    return span.select(F.explode(cal.month_ends_between(F.col("a"), F.col("b"))).alias("month_end"))


# --- cleaning ----------------------------------------------------------------------------------------------------


def _raw_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with the faults that files have: impossible dates, words for numbers, repeated rows."""
    o = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("msno"), F.substring("o_orderpriority", 1, 1).alias("payment_method_id"), F.lit("30").alias("payment_plan_days"), F.when(o % 11 == 0, "n/a").otherwise((o % 200).cast("string")).alias("plan_list_price"),
        F.when(o % 17 == 0, F.lit(None).cast("string")).otherwise((o % 150).cast("string")).alias("actual_amount_paid"), (o % 2).cast("string").alias("is_auto_renew"), F.when(o % 13 == 0, "20170230").otherwise(day).alias("transaction_date"),
        F.when(o % 19 == 0, "").otherwise(day).alias("membership_expire_date"), F.lit("0").alias("is_cancel"), o,
    )
    return rows.drop("o_orderkey").unionByName(rows.filter(o % 5 == 0).drop("o_orderkey"))


@query(sql.CLEAN_TX)
def q_clean_tx(spark, sf_dir):
    return clean.clean_tx(_raw_tx(spark, sf_dir)).drop("tx_id")


@query(sql.CLEAN_MEMBERS)
def q_clean_members(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = c.select(F.col("c_custkey").cast("string").alias("msno"), F.col("c_nationkey").cast("string").alias("city"), F.when(F.col("c_mktsegment") == "BUILDING", "male").alias("gender"), F.lit("19950131").alias("registration_init_time"), F.lit(1).alias("line"))
    again = raw.withColumn("city", F.lit("99")).withColumn("registration_init_time", F.lit("0")).withColumn("line", F.lit(2))
    late = again.filter(F.col("msno").cast("long") % 3 == 0).withColumn("line", F.lit(0))
    return clean.clean_members(raw.unionByName(again).unionByName(late), F.col("line"))


@query(sql.CLIP)
def q_clip_secs(spark, sf_dir):
    d = star_daily_logs(spark, sf_dir)
    return d.groupBy("msno").agg(F.sum(clean.clip_seconds(F.col("total_secs") - 5000)).alias("secs"), F.count_if(F.col("total_secs") - 5000 > clean.DAY_SECONDS).alias("over"), F.count_if(F.col("total_secs") < 5000).alias("under"))


@query(sql.AGES)
def q_valid_age(spark, sf_dir):
    return star_members(spark, sf_dir).select("msno", clean.valid_age(F.col("bd")).alias("age"), clean.valid_age(F.col("bd"), 1, 89).alias("age_a"), clean.indicator(F.col("city"), 5).alias("city_5"))


@query(sql.with_ctes("SELECT msno, month_end, num_25, num_50, num_75, num_985, num_100, num_unq, round(total_secs, 6) total_secs, days_active, last_date FROM logs", "logs"))
def q_logs_monthly(spark, sf_dir):
    return star(spark, sf_dir).logs


# --- as-of reads -------------------------------------------------------------------------------------------------


def _view(spark: SparkSession, sf_dir: str) -> AsOf:
    return AsOf(star(spark, sf_dir), tuple(CUTOFFS))


@query(sql.with_ctes("SELECT cutoff, msno, tx_id, transaction_date FROM cut JOIN tx ON transaction_date <= cutoff", "tx"))
def q_visible_tx(spark, sf_dir):
    return _view(spark, sf_dir).tx.select("cutoff", "msno", "tx_id", "transaction_date")


@query(sql.with_ctes("SELECT cutoff, msno, month_end, days_active FROM cut JOIN logs ON month_end <= cutoff", "logs"))
def q_visible_logs(spark, sf_dir):
    return _view(spark, sf_dir).logs.select("cutoff", "msno", "month_end", "days_active")


@query(sql.with_ctes("SELECT cutoff, msno, registration_init_time FROM cut JOIN members ON registration_init_time IS NULL OR registration_init_time <= cutoff", "members"))
def q_visible_members(spark, sf_dir):
    return _view(spark, sf_dir).members.select("cutoff", "msno", "registration_init_time")


@query(sql.with_ctes("SELECT cutoff, msno, tx_id, transaction_date, membership_expire_date, plan_list_price, CAST(is_cancel AS BIGINT) AS is_cancel FROM last_tx", "tx", "last_tx"))
def q_asof_last_tx(spark, sf_dir):
    return _view(spark, sf_dir).last_tx().select("cutoff", "msno", "tx_id", "transaction_date", "membership_expire_date", "plan_list_price", "is_cancel")


@query(sql.with_ctes("SELECT msno, cutoff, expire_date FROM pop", "tx", "last_tx", "pop"))
def q_population(spark, sf_dir):
    return labels.population(star(spark, sf_dir), CUTOFFS)


@query(sql.with_ctes("SELECT msno, cutoff, expire_date, CAST(is_churn AS BIGINT) AS is_churn FROM lab", "tx", "last_tx", "pop", "lab"))
def q_churn_labels(spark, sf_dir):
    ds = star(spark, sf_dir)
    return labels.churn_labels(ds, labels.population(ds, CUTOFFS))


@query(sql.with_ctes("SELECT cutoff, count(*) n, round(avg(is_churn), 6) churn_rate FROM lab GROUP BY cutoff", "tx", "last_tx", "pop", "lab"))
def q_churn_rate_by_cutoff(spark, sf_dir):
    ds = star(spark, sf_dir)
    return labels.churn_rate(labels.churn_labels(ds, labels.population(ds, CUTOFFS)))


# --- features ----------------------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir)
    return features.build(ds, labels.population(ds, CUTOFFS), CUTOFFS)


def _group(names: tuple[str, ...]):
    def run(spark, sf_dir):
        return _features(spark, sf_dir).select("msno", "cutoff", *names)

    return run


for _name, _names in {"q_feat_last": features.LAST, "q_feat_history": features.HISTORY, "q_feat_lapses": features.LAPSES, "q_feat_profile": features.PROFILE, "q_feat_listening": features.LISTENING, "q_feat_all_multi_cutoff": features.FEATURES}.items():
    _f = _group(_names)
    _f.__name__ = _name
    query(sql.features(_names))(_f)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, labels and the score of a fixed rule."""
    t = features.training_table(star(spark, sf_dir), CUTOFFS)
    k = 20 + 12 * (1 - F.col("auto_renew")) + 25 * F.col("cancel_last") + 4 * F.least(F.col("n_lapses"), F.lit(5.0)) + F.floor(F.least(F.col("days_since_last_tx"), F.lit(300.0)) / 10)
    return t.withColumn("p", k.cast("double") / F.lit(100.0))


# --- recipes -----------------------------------------------------------------------------------------------------


def _recipe(key: str, published: bool):
    def run(spark, sf_dir):
        ds = star(spark, sf_dir)
        r = recipes.RECIPES[key]
        return (r.published if published else r.honest)(ds, labels.population(ds, CUTOFFS), CUTOFFS)

    return run


for _key in recipes.RECIPES:
    for _published in (True, False):
        _f = _recipe(_key, _published)
        _f.__name__ = f"q_recipe_{_key.lower()}_{'published' if _published else 'clean'}"
        query(sql.recipe(_key, _published))(_f)


@query(sql.MODES)
def q_mode_per_user(spark, sf_dir):
    return star_tx(spark, sf_dir).groupBy("msno").agg(F.mode("payment_plan_days", True).alias("mode_plan_days"), F.mode("payment_method_id", True).alias("mode_payment_method"), F.mode(F.quarter("transaction_date"), True).alias("mode_quarter"))


# --- leakage -----------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str, key: str) -> tuple[DataFrame, DataFrame]:
    ds = star(spark, sf_dir)
    scored = labels.churn_labels(ds, labels.population(ds, CUTOFFS))
    r = recipes.RECIPES[key]
    published, honest = r.published(ds, scored, CUTOFFS), r.honest(ds, scored, CUTOFFS)
    return leakage.long_form(published, honest, [c for c in published.columns if c not in leakage.KEYS]), scored


@query(sql.changed("B"))
def q_changed_share(spark, sf_dir):
    return leakage.changed_share(_pairs(spark, sf_dir, "B")[0])


@query(sql.changed("C"))
def q_changed_share_c(spark, sf_dir):
    return leakage.changed_share(_pairs(spark, sf_dir, "C")[0])


@query(sql.signal("B"))
def q_signal_auc(spark, sf_dir):
    pairs, scored = _pairs(spark, sf_dir, "B")
    return leakage.signal(pairs.join(scored.select("msno", "cutoff", "is_churn"), leakage.KEYS), ["feature"], "a").withColumn("signal", F.round("signal", 4))


@query(sql.leak_table("B"))
def q_leak_table(spark, sf_dir):
    pairs, scored = _pairs(spark, sf_dir, "B")
    return leakage.leak_table(pairs, scored)


@query(f"SELECT feature, signal_published, signal_honest FROM ({sql.leak_table('A')}) t WHERE leaked AND signal_published - signal_honest > 0.02 ORDER BY signal_published - signal_honest DESC, feature LIMIT 3")
def q_leak_headline(spark, sf_dir):
    pairs, scored = _pairs(spark, sf_dir, "A")
    return leakage.headline(leakage.leak_table(pairs, scored))


# --- metrics -----------------------------------------------------------------------------------------------------


@query(sql.AUC)
def q_auc_exact(spark, sf_dir):
    return metrics.ranking(_labelled(spark, sf_dir), ["cutoff"]).select("cutoff", "auc")


@query(sql.AP)
def q_avg_precision(spark, sf_dir):
    return metrics.ranking(_labelled(spark, sf_dir), ["cutoff"]).select("cutoff", "ap")


@query(sql.LOSS)
def q_logloss_brier(spark, sf_dir):
    return metrics.probability(_labelled(spark, sf_dir), ["cutoff"])


@query(sql.HARD)
def q_hard_metrics(spark, sf_dir):
    return metrics.hard(_labelled(spark, sf_dir), ["cutoff"])


# --- models ------------------------------------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str, cached: bool = False) -> tuple[DataFrame, DataFrame]:
    t = features.training_table(star(spark, sf_dir), CUTOFFS)
    t = t.cache() if cached else t
    return t.filter(F.col("cutoff") < F.lit(CUTOFFS[-1])), t.filter(F.col("cutoff") == F.lit(CUTOFFS[-1]))


@query(sql.NOBODY)
def q_nobody_churns(spark, sf_dir):
    return models.nobody_churns(*_split(spark, sf_dir)).select("msno", "cutoff", "p")


@query(sql.RULE)
def q_auto_renew_rule(spark, sf_dir):
    return models.auto_renew_rule(*_split(spark, sf_dir)).select("msno", "cutoff", "p")


@query()
def q_logistic(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    train = train.cache()
    return models.logistic(train.count()).fit(train).predict(test).select("msno", "cutoff", "p")


@query()
def q_boosted(spark, sf_dir):
    train, test = _split(spark, sf_dir, cached=True)
    return models.boosted().fit(train).predict(test).select("msno", "cutoff", "p")


@query()
def q_forest(spark, sf_dir):
    ds = star(spark, sf_dir)
    scored = labels.churn_labels(ds, labels.population(ds, CUTOFFS))
    b = recipes.RECIPES["B"].honest(ds, scored, CUTOFFS).join(scored, leakage.KEYS).cache()
    columns = tuple(c for c, kind in b.dtypes if kind == "double")
    return models.forest(columns).fit(b).predict(b).select("msno", "cutoff", "p")


@query(sql.KNN)
def q_knn_27(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("y", (F.col("label") % 2).cast("double"))
    return knn.rates(e, e, "vec_id", "embedding", "y").withColumnRenamed("id", "vec_id")


# --- money -------------------------------------------------------------------------------------------------------


@query(sql.CURVE)
def q_savings_curve(spark, sf_dir):
    return money.savings_curve(_labelled(spark, sf_dir), MONEY, ("cutoff",))


@query(sql.BEST)
def q_best_threshold(spark, sf_dir):
    return money.best_threshold(_labelled(spark, sf_dir), MONEY, ("cutoff",))


@query(sql.SAVINGS)
def q_savings(spark, sf_dir):
    return money.savings(_labelled(spark, sf_dir), 0.5, MONEY, ("cutoff",))


@query(sql.POLICY)
def q_policy_table(spark, sf_dir):
    return money.policy_table(_labelled(spark, sf_dir), MONEY, 0.09)


@query(sql.BANDS)
def q_bands(spark, sf_dir):
    return money.bands(_labelled(spark, sf_dir))


@query(sql.CALCULATOR)
def q_calculator(spark, sf_dir):
    return money.calculator(money.bands(_labelled(spark, sf_dir)), MONEY)


@query(sql.GAIN)
def q_expected_gain(spark, sf_dir):
    return _labelled(spark, sf_dir).select("msno", "cutoff", money.expected_gain(F.col("p"), MONEY).alias("gain"), F.lit(MONEY.break_even).alias("break_even"))


@query(sql.OFFERS)
def q_top_offers(spark, sf_dir):
    t = _labelled(spark, sf_dir).filter(F.col("cutoff") == F.lit(CUTOFFS[-1]))
    return replay.offers(t, 0.3, MONEY, 200)


# --- drift -------------------------------------------------------------------------------------------------------


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _features(spark, sf_dir)
    return f.filter(F.col("cutoff") == F.lit(CUTOFFS[0])), f.filter(F.col("cutoff") == F.lit(CUTOFFS[-1]))


@query(sql.EDGES)
def q_drift_reference(spark, sf_dir):
    reference, _ = _ends(spark, sf_dir)
    cut = drift.edges(reference)
    return drift.shares(reference, cut)


@query(sql.PSI_NUMERIC)
def q_psi_numeric(spark, sf_dir):
    reference, current = _ends(spark, sf_dir)
    cut = drift.edges(reference)
    return drift.psi(drift.shares(reference, cut), drift.shares(current, cut))


@query(sql.PSI_CATEGORY)
def q_psi_categorical(spark, sf_dir):
    return drift.psi(*(drift.category_shares(x) for x in _ends(spark, sf_dir)))


@query(sql.DRIFT)
def q_drift_report(spark, sf_dir):
    return drift.report(*_ends(spark, sf_dir))


# --- samples -----------------------------------------------------------------------------------------------------


@query(sql.SAMPLE)
def q_hash_sample(spark, sf_dir):
    return sampling.sample(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", 100)


@query(sql.SPLIT)
def q_stratified_split(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("y"))
    return sampling.stratified_split(c, "o_orderkey", "y")


@query(sql.OVERSAMPLE)
def q_oversample(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 10 == 0).cast("int").alias("y"))
    return sampling.oversample(c, "o_orderkey", "y").groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


# --- audit and replay --------------------------------------------------------------------------------------------


@query(sql.PROFILE)
def q_profile(spark, sf_dir):
    return audit.profile(star(spark, sf_dir))


@query(sql.PICK)
def q_pick_cutoffs(spark, sf_dir):
    ds = star(spark, sf_dir)
    cut = audit.pick_cutoffs(ds.data_end, 4)
    rows = [("data_end", ds.data_end), ("test", cut["test"]), ("valid", cut["valid"]), *((f"train_{i}", c) for i, c in enumerate(cut["train"]))]
    return spark.createDataFrame(rows, "role string, cutoff date")


@query(sql.REPLAY)
def q_replay_history(spark, sf_dir):
    return replay.rule_history(star(spark, sf_dir), date(1998, 1, 31), 12)


@query(sql.with_ctes("SELECT msno, month_end, days_active, round(total_secs, 6) total_secs FROM logs", "logs"))
def q_stream_monthly_logs(spark, sf_dir):
    return streams.monthly_from_stream(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return star(spark, sf_dir)
