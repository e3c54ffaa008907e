"""Command line: make-sample, prepare, audit, report, replay-step, replay-run, replay-reset.

Settings come from a TOML file with the tables [data] (prepared, sample), [money], [audit] (n_train_months, trees,
forest_trees, out) and [replay] (start, train_months, retrain_below_auc, drift_warn, offer_list_size, trees, learned,
folder); what it lacks has the defaults of the library.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.operators import money
from tidemark.plans import audit, replay, report
from tidemark.sources import raw, synth
from tidemark.sources.shared import Folder

BANNER = "> The data are made up: customers drawn by a seeded generator. The figures show the method, not a market."


def settings(path: str | None) -> dict:
    found = raw.load_config(path) if path else {}
    return {name: dict(found.get(name, {})) for name in ("data", "money", "audit", "replay")}


def assumptions(cfg: dict) -> money.Assumptions:
    return money.Assumptions(**cfg["money"])


def replay_config(cfg: dict) -> replay.Config:
    known = {f.name for f in fields(replay.Config)}
    own = {k: v for k, v in cfg["replay"].items() if k != "folder"}
    if unknown := set(own) - known:
        raise ValueError(f"[replay] has no setting {', '.join(sorted(unknown))}")
    if isinstance(own.get("start"), str):
        own["start"] = date.fromisoformat(own["start"])
    return replay.Config(**own)


def _replay(spark: SparkSession, cfg: dict) -> replay.Replay:
    ds = raw.load(spark, cfg["data"]["prepared"])
    return replay.Replay(ds, cfg["replay"].get("folder", "replay"), replay_config(cfg), assumptions(cfg))


def _report(cfg: dict) -> None:
    folder = Path(cfg["audit"].get("out", "reports"))
    result = json.loads((folder / "audit.json").read_text())
    report.write_all(result, folder)
    if cfg["data"].get("sample"):
        for name in ("results.md", "summary.md"):
            page = folder / name
            page.write_text(f"{BANNER}\n\n{page.read_text()}")
    readme = folder / "README.md"
    if readme.exists() and "<!-- headline -->" in readme.read_text():
        report.replace_block(readme, "headline", report.headline(result))


def _audit(spark: SparkSession, cfg: dict) -> None:
    own = cfg["audit"]
    more = {k: own[k] for k in ("trees", "forest_trees") if k in own}
    result = audit.run(raw.load(spark, cfg["data"]["prepared"]), assumptions(cfg), own.get("n_train_months", 4), **more)
    audit.save(result, Path(own.get("out", "reports")) / "audit.json")
    _report(cfg)


def _said(j: replay.Journal) -> str:
    last = max(j.checks.values(), key=lambda s: s.cutoff, default=None)
    checked = "nothing settled yet" if last is None or last.auc is None else f"AUC {last.auc:.3f} for {last.cutoff}"
    return f"{j.last.day} (loop {j.last.loop}): model {j.model.version}, {j.last.customers} scored, {len(j.open)} open, {checked}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description="Point-in-time churn audit and replay.")
    parser.add_argument("--config", help="a TOML file of settings")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("make-sample", help="draw made-up customers, raw and prepared")
    one.add_argument("out")
    one.add_argument("--users", type=int, default=8000)
    one.add_argument("--seed", type=int, default=7)
    one = commands.add_parser("prepare", help="raw CSV files to Parquet tables")
    one.add_argument("raw")
    one.add_argument("out")
    commands.add_parser("audit", help="audit the recipes and models, and write the reports")
    commands.add_parser("report", help="write the reports of the last audit again")
    commands.add_parser("replay-step", help="replay one month")
    one = commands.add_parser("replay-run", help="replay several months")
    one.add_argument("--months", type=int, default=12)
    commands.add_parser("replay-reset", help="forget a replay")
    asked = parser.parse_args(argv)
    cfg = settings(asked.config)
    if asked.command == "report":
        _report(cfg)
        return 0
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match asked.command:
        case "make-sample":
            synth.write_sample(spark, f"{asked.out}/raw", asked.users, asked.seed)
            raw.prepare(spark, f"{asked.out}/raw", f"{asked.out}/prepared")
        case "prepare":
            raw.prepare(spark, asked.raw, asked.out)
        case "audit":
            _audit(spark, cfg)
        case "replay-step" | "replay-run":
            job = _replay(spark, cfg)
            for _ in range(getattr(asked, "months", 1)):
                print(_said(job.tick()), flush=True)
        case "replay-reset":
            folder = Folder(spark, cfg["replay"].get("folder", "replay"))
            for name in ("journal", "ticks", "months", "monitor.json"):
                folder.remove(name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
