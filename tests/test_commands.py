"""The command lines, end to end on a small batch."""

from tallyloom.plans import commands


def test_generate_measure_and_draw(spark, tmp_path, capsys):
    at, page = str(tmp_path / "b"), tmp_path / "d.html"
    assert commands.main(["generate", at, "--records", "200", "--seed", "3", "--family", "stress"]) == 0
    assert "rows.gateway_events" in capsys.readouterr().out
    assert commands.main(["ambiguity", at]) == 0
    out = capsys.readouterr().out
    assert "Refund deltas" in out and "gates" in out
    assert commands.main(["dashboard", at, "--html", str(page)]) == 0
    text = page.read_text()
    assert all(f"<h2>{x}</h2>" in text for x in ("Scoreboard", "Size", "Outcomes", "By scenario", "Curve", "Text similarity of contested lines", "Candidates of a delta"))
