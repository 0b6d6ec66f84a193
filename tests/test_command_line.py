import io
import json
import sys

import pytest

from glyphlake import api
from glyphlake.__main__ import run
from test_reports import FILES


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "build"
    (root / "own").mkdir(parents=True)
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    (root / "own" / "x.txt").write_text("left​ out")
    return root


def test_standard_input(spark, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO("a\u200bb".encode())))
    assert run(spark, ["inspect", "-"]) == 1
    assert json.loads(capsys.readouterr().out)["report"]["suspicious_total"] == 1
    monkeypatch.setattr(api, "MAX_INPUT", 3)
    with pytest.raises(ValueError):
        api.standard_input(spark, io.BytesIO(b"abcd"))


def test_verbs(spark, folder, tmp_path, capsys):
    lines = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert run(spark, ["audit", str(folder), "--skip", "own"]) == 1
    rows = lines()
    assert len(rows) == len(FILES) + 1 and rows[-1]["total"] == 13 and sum(r.get("reason") is not None for r in rows) == 1
    assert run(spark, ["audit", str(folder), "--sarif"]) == 1
    assert lines()[0]["version"] == "2.1.0"
    assert run(spark, ["check", str(folder / "a.txt")]) == 0 and lines() == []
    assert run(spark, ["check", str(folder / "d.png"), str(folder / "a.txt")]) == 1
    assert [r["path"].rpartition("/")[2] for r in lines()] == ["d.png"]
    assert run(spark, ["inspect", str(folder / "c.txt")]) == 3 and run(spark, ["inspect", "--as", "image", str(folder / "d.png")]) == 1
    capsys.readouterr()
    assert run(spark, ["detect", "--key", "secret", str(folder / "a.txt")]) == 0
    assert [d["available"] for d in lines()[0]["detections"]] == [False, True, False, True]
    assert run(spark, ["text-audit", str(folder / "b.txt"), "--out", str(tmp_path / "rows")]) == 1 and lines() == []
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    assert run(spark, ["check", str(folder / "a.txt"), "--threshold", "2"]) == 2
    with pytest.raises(SystemExit):
        run(spark, ["nothing"])
