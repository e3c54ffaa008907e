"""A recipe's audit, the replay, reports and streams on made-up customers."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.test_rules import scrambled
from tidemark.operators import money
from tidemark.plans import audit, replay, report
from tidemark.sources import raw, synth
from tidemark.streaming import monthly


@pytest.fixture(scope="module")
def ds(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    synth.write_sample(spark, f"{folder}/raw", 400, 5)
    raw.prepare(spark, f"{folder}/raw", f"{folder}/prepared")
    return raw.load(spark, f"{folder}/prepared")


def test_replay_keeps_state_between_processes(ds, tmp_path):
    config = replay.Config(start=date(2016, 7, 31), learned=False, retrain_below_auc=1.1)
    for _ in range(4):
        j = replay.Replay(ds, str(tmp_path), config).tick()
    assert replay.Replay(ds, str(tmp_path), config).journal() == j
    ends = [date(2016, 7, 31), date(2016, 8, 31), date(2016, 9, 30), date(2016, 10, 31)]
    assert [e.day for e in j.running] == ends and sorted(j.checks) == ends[:2]
    assert all(s.leavers >= s.reached for s in j.checks.values())
    assert [e.day for e in j.open] == ends[2:] and j.model.version >= 2
    assert all((tmp_path / e.folder / "scored").exists() == (e.day in ends[2:]) for e in j.entries)
    page = json.loads((tmp_path / "monitor.json").read_text())
    assert page["clock"]["today"] == "2016-10-31" and page["offers"]["count"] >= len(page["offers"]["top"]) > 0
    assert [m["leavers"] is None for m in page["months"]] == [False, False, True, True]


def test_replay_starts_over(ds, tmp_path):
    job = replay.Replay(ds, str(tmp_path), replay.Config(start=date(2017, 2, 28), learned=False))
    assert [job.tick().last.loop for _ in range(3)] == [1, 1, 2]
    j = job.journal()
    assert j.last.day == date(2017, 2, 28) and [e.day for e in j.open] == [date(2017, 2, 28)] and j.last.trained.why == "a new loop began"


def test_a_tick_that_breaks_off_leaves_nothing(ds, tmp_path, monkeypatch):
    job = replay.Replay(ds, str(tmp_path), replay.Config(start=date(2016, 7, 31), learned=False))
    before = job.tick()

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(replay.Replay, "_drift", broken)
    with pytest.raises(RuntimeError):
        job.tick()
    assert job.journal() == before and len(list((tmp_path / "ticks").iterdir())) == 2
    monkeypatch.undo()
    j = job.tick()
    assert j.last.day == date(2016, 8, 31) and {f"ticks/{p.name}" for p in (tmp_path / "ticks").iterdir()} == {e.folder for e in j.entries}


def test_what_a_tick_does_is_decided_from_the_journal():
    config, end = replay.Config(start=date(2016, 7, 31)), date(2016, 12, 31)
    entry = lambda n, loop, day, version=1, settled=(): replay.Entry(n, loop, day, f"ticks/{n}", version, 0.5, 1, 1, 0.1, settled)
    check = lambda day, auc, version=1: replay.Settled(day, version, auc, None, None, 0.0, 0, 0)
    assert replay.next_move(replay.Journal(), config, end) == replay.Move(date(2016, 7, 31), 1, (), "no model yet")
    days = [date(2016, 7, 31), date(2016, 8, 31), date(2016, 9, 30)]
    j = replay.Journal(tuple(entry(i, 1, d) for i, d in enumerate(days[:2])))
    move = replay.next_move(j, config, end)
    assert (move.day, move.loop, move.fresh) == (days[2], 1, None) and [e.day for e in move.due] == [c for c in days[:2] if replay.cal.mature(c, days[2])]
    assert replay.training_reason(move, [check(days[0], 0.7)], 1, 0.8) and not replay.training_reason(move, [check(days[0], 0.7)], 2, 0.8)
    assert not replay.training_reason(move, [check(days[0], 0.7), check(days[1], None)], 1, 0.8) and not replay.training_reason(move, [check(days[0], 0.7), check(days[1], 0.9)], 1, 0.8)
    over = replay.next_move(replay.Journal((*j.entries, entry(2, 1, end))), config, end)
    assert (over.day, over.loop, over.due) == (days[0], 2, ()) and over.fresh


def test_replay_predictions_ignore_the_future(ds, spark, tmp_path):
    config, found = replay.Config(start=date(2016, 6, 30), learned=False), []
    for name, data in (("a", ds), ("b", scrambled(ds, date(2016, 6, 30), spark))):
        j = replay.Replay(data, str(tmp_path / name), config).tick()
        found.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / name / j.last.folder / "scored")).select("msno", "p").collect())))
    assert found[0] == found[1] and found[0]


def test_learned_replay(ds, tmp_path):
    job = replay.Replay(ds, str(tmp_path), replay.Config(start=date(2016, 10, 31), trees=5))
    one = job.tick()
    assert one.model.spec["kind"] == "boosted" and one.last.customers > 0
    assert replay.Replay(ds, str(tmp_path), job.config).tick().last.day == date(2016, 11, 30)


def test_recipe_audit_finds_the_leak(ds):
    cut = audit.pick_cutoffs(ds.data_end, 2)
    result = audit.audit_recipe(audit.recipes.RECIPES["B"], ds, cut, trees=3)
    assert set(result["results"]) == {"as_published", "clean_features_random_split", "honest_time_split"}
    assert any(x["leaked"] and x["feature"] == "membership_expire_date" for x in result["leaks"])


def test_report(tmp_path):
    score = {"auc": 0.9, "accuracy": 0.9, "f1": 0.5, "precision": 0.5, "recall": 0.5}
    leak = {"feature": "is_cancel", "changed_share": 0.1, "changed_strict": 0.1, "signal_published": 0.9, "signal_honest": 0.6, "leaked": True}
    recipe = {"key": "B", "results": {k: score for k in ("as_published", "clean_features_random_split", "honest_time_split")}, "leaks": [leak], "auc_drop": 0.1}
    table = {"boosted": {"auc": 0.8, "ap": 0.4, "log_loss": 0.2, "saved_money_threshold": 1000.0}}
    policy = {"policy": "money_threshold", "offers": 100, "leavers_reached": 30, "saved": 1300.0}
    result = {"cutoffs": {"test": date(2017, 1, 31), "valid": date(2016, 11, 30)}, "recipes": [recipe], "models": {"table": table, "money": {"comparison": [policy]}, "top_features": {"auto_renew": 0.4}}}
    audit.save(result, tmp_path / "audit.json")
    report.write_all(json.loads((tmp_path / "audit.json").read_text()), tmp_path)
    assert "is_cancel" in (tmp_path / "results.md").read_text() and "300 leavers" in (tmp_path / "summary.md").read_text()
    (tmp_path / "x.md").write_text("a <!-- t -->old<!-- /t --> b")
    report.replace_block(tmp_path / "x.md", "t", "new")
    assert (tmp_path / "x.md").read_text() == "a <!-- t -->\nnew\n<!-- /t --> b"


def test_generator_is_the_same_on_every_run(spark):
    one, two = (synth.generate(spark, 30, 7) for _ in range(2))
    for name in one:
        assert one[name].exceptAll(two[name].repartition(3)).isEmpty()


def test_ticks_come_in_order(spark, tmp_path):
    for m in (1, 2, 3):
        spark.range(m).withColumn("m", F.lit(m)).coalesce(1).write.mode("append").parquet(str(tmp_path / "months"))
    seen = []
    stream = spark.readStream.schema("id long, m int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "months"))
    monthly.ticks(stream, lambda df, i: seen.append((i, [r.m for r in df.select("m").distinct().collect()])), str(tmp_path / "check")).awaitTermination()
    assert [i for i, _ in seen] == [0, 1, 2] and sorted(m for _, x in seen for m in x) == [1, 2, 3]


def test_labels_by_event_time(spark, tmp_path):
    at = datetime.fromisoformat
    scored = [("a", "2016-01-31", "2016-02-10"), ("b", "2016-01-31", "2016-02-10"), ("c", "2016-01-31", "2016-02-10"), ("z", "2016-06-30", "2016-07-10")]
    tx = [("a", "2016-02-20", "2016-04-01", 0), ("a", "2016-02-25", "2016-05-01", 0), ("b", "2016-03-25", "2016-05-01", 0), ("c", "2016-02-11", "2016-03-11", 1), ("z", "2016-07-11", "2016-09-01", 0)]
    spark.createDataFrame([(m, at(c), at(e)) for m, c, e in scored], "msno string, cutoff_ts timestamp, expire_ts timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(m, at(t), at(e), c) for m, t, e, c in tx], "msno string, tx_ts timestamp, tx_expire_ts timestamp, is_cancel int").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda p: spark.readStream.schema(spark.read.parquet(str(tmp_path / p)).schema).parquet(str(tmp_path / p))
    drained = monthly.run_available(monthly.streamed_labels(read("s"), read("t")), ["msno", "cutoff", "is_churn"], "append")
    out = drained.collect()
    got = {r.msno: r.is_churn for r in out}
    assert len(got) == len(out) and got["a"] == 0 and got["b"] == 1 and got["c"] == 1


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[money]\noffer_cost = 5.0\n')
    assert money.Assumptions(**raw.load_config(tmp_path / "c.toml")["money"]).break_even == 5 / 60


def test_a_stream_reads_a_file_and_a_folder_alike(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    one = monthly.monthly_from_stream(spark, f"{small}/lineitem.parquet", f"{small}/orders.parquet")
    spark.read.parquet(f"{small}/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    other = monthly.monthly_from_stream(spark, str(tmp_path / "lineitem.parquet"), f"{small}/orders.parquet")
    rows = lambda df: sorted((r.msno, r.month_end, r.days_active, round(r.total_secs, 6)) for r in df.collect())
    assert rows(one) == rows(other) and len(rows(one)) > 1000
