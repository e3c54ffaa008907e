"""Every command on a few made-up customers."""

from __future__ import annotations

import json

import pytest

from tidemark import __main__ as cli


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("commands")
    assert cli.main(["make-sample", f"{at}/sample", "--users", "400", "--seed", "5"], spark) == 0
    (at / "c.toml").write_text(
        f'[data]\nprepared = "{at}/prepared"\nsample = true\n[money]\noffer_cost = 4.0\n[audit]\nn_train_months = 2\ntrees = 3\nforest_trees = 3\nout = "{at}/reports"\n'
        f'[replay]\nstart = "2016-10-31"\nlearned = false\nfolder = "{at}/replay"\n'
    )
    assert cli.main(["prepare", f"{at}/sample/raw", f"{at}/prepared"], spark) == 0
    return at


def test_replay_commands(spark, made, capsys):
    run = lambda *x: cli.main(["--config", f"{made}/c.toml", *x], spark)
    assert run("replay-step") == 0 and run("replay-run", "--months", "2") == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x[:10] for x in lines] == ["2016-10-31", "2016-11-30", "2016-12-31"]
    page = json.loads((made / "replay/monitor.json").read_text())
    assert page["clock"]["today"] == "2016-12-31" and page["settings"]["offer_cost"] == 4.0
    assert run("replay-reset") == 0 and not (made / "replay/journal").exists() and not (made / "replay/ticks").exists()


def test_the_whole_audit(spark, made):
    (made / "reports").mkdir()
    (made / "reports/README.md").write_text("<!-- headline -->\n<!-- /headline -->\n")
    assert cli.main(["--config", f"{made}/c.toml", "audit"], spark) == 0
    found = json.loads((made / "reports/audit.json").read_text())
    assert [r["key"] for r in found["recipes"]] == ["A", "B", "C"] and set(found["models"]["table"]) == {"nobody_churns", "auto_renew_rule", "logistic", "boosted"}
    assert found["models"]["table"]["nobody_churns"]["auc"] == pytest.approx(0.5)
    assert (made / "reports/results.md").read_text().startswith(cli.BANNER)
    assert "recipe" in (made / "reports/README.md").read_text()
    assert cli.main(["--config", f"{made}/c.toml", "report"]) == 0


def test_unknown_settings_are_told(tmp_path):
    (tmp_path / "c.toml").write_text("[replay]\nstrat = 1\n")
    with pytest.raises(ValueError, match="strat"):
        cli.replay_config(cli.settings(str(tmp_path / "c.toml")))
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
