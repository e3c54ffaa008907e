"""Markdown of an audit document, and replacing a marked block of a file."""

from __future__ import annotations

import re
from pathlib import Path


def euros(x: float) -> str:
    return f"{'-' if x < 0 else ''}€{abs(x):,.0f}"


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f} %"


def _table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), *rows)])


def headline(audit: dict) -> str:
    """AUC of each recipe as published, on clean features and honestly in time, and what leaked."""
    rows = []
    for r in audit["recipes"]:
        leaks = [x["feature"] for x in r["leaks"] if x["leaked"] and x["signal_published"] - x["signal_honest"] > 0.02][:3]
        rows.append([r["key"], *(str(r["results"][k]["auc"]) for k in ("as_published", "clean_features_random_split", "honest_time_split")), ", ".join(leaks) or "-"])
    return _table(["recipe", "published", "clean, random split", "honest", "leaks"], rows)


def results(audit: dict) -> str:
    m = audit["models"]
    models = _table(["model", "AUC", "AP", "log-loss", "saved"], [[name, *(f"{v[k]:.3f}" if v[k] is not None else "-" for k in ("auc", "ap", "log_loss")), euros(v["saved_money_threshold"])] for name, v in m["table"].items()])
    policies = _table(["policy", "offers", "reached", "saved"], [[p["policy"], f"{p['offers']:,}", f"{p['leavers_reached']:,}", euros(p["saved"])] for p in m["money"]["comparison"]])
    top = _table(["feature", "share of gain"], [[f, percent(x)] for f, x in m["top_features"].items()])
    leaks = [f"### Recipe {r['key']}\n\n" + _table(["feature", "changed", "signal", "honest signal"], [[x["feature"], percent(x["changed_share"]), str(x["signal_published"]), str(x["signal_honest"])] for x in r["leaks"]]) for r in audit["recipes"]]
    return "\n\n".join(["# Results", f"Test month {audit['cutoffs']['test']}, validation {audit['cutoffs']['valid']}.", headline(audit), "## Models", models, "## Money", policies, "## Features", top, "## Leaks", *leaks]) + "\n"


def summary(audit: dict) -> str:
    """One page for a manager: what the published scores hide, and what the offers bring."""
    worst = max((r for r in audit["recipes"] if r["auc_drop"] is not None), key=lambda r: r["auc_drop"], default=None)
    best = next(p for p in audit["models"]["money"]["comparison"] if p["policy"] == "money_threshold")
    lines = ["# Summary", headline(audit)]
    if worst:
        lines.append(f"The largest gap between a published and an honest score is {worst['auc_drop']:.3f} (recipe {worst['key']}).")
    lines.append(f"Offers by the chosen threshold save {euros(best['saved'])}: {1000 * best['leavers_reached'] / max(1, best['offers']):.0f} leavers reached for 1,000 offers.")
    return "\n\n".join(lines) + "\n"


def replace_block(path: str | Path, name: str, text: str) -> None:
    """Put text between the markers `<!-- name -->` and `<!-- /name -->` of a file."""
    path = Path(path)
    old = path.read_text()
    new, n = re.subn(rf"(<!-- {re.escape(name)} -->).*?(<!-- /{re.escape(name)} -->)", lambda m: f"{m[1]}\n{text}\n{m[2]}", old, flags=re.S)
    if n != 1:
        raise ValueError(f"{path} has {n} blocks {name}")
    path.write_text(new)


def write_all(audit: dict, folder: str | Path) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "results.md").write_text(results(audit))
    (folder / "summary.md").write_text(summary(audit))
