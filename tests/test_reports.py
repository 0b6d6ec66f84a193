import json

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import reports
from glyphlake.sources.corpus import read_files
from test_inspection import LATEX, box, id3, png, zipped

FILES = {
    "a.txt": "plain words".encode(),
    "b.txt": "hid\u200bden words\u00a0and space".encode(),
    "c.txt": b"\x89PNG\r\n\x1a\n",
    "d.png": png((b"caBX", b"")),
    "e.md": "---\ngenerator: Claude\n---\n\u200b".encode(),
    "f.tex": LATEX,
    "g.docx": zipped(**{"word/document.xml": "<w:t>a\u200b</w:t>", "docProps/app.xml": "OpenAI"}),
    "h": b"no known kind",
    "i": b"%PDF /Producer (Claude)",
    "j.mp4": box(b"ftyp", b"isom") + box(b"moov", box(b"udta", b"x")),
    "k.html": b'<meta name="generator" content="WordPress">',
    "l.txt": ("We delve into this topic with careful context and practical examples. " * 12).encode(),
    "m.txt": b"a\xffb",
    "n.mp3": id3((b"TIT2", b"x"), size=500),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in FILES.items()] + [("x/missing.bin", None)], "path string, content binary")


def test_reports(files):
    rows = {r.path: r.report for r in reports.inspect_files(files).collect()}
    assert {p: (r.kind, r.format) for p, r in rows.items() if not r.error} == {
        "a.txt": ("text", ""), "b.txt": ("text", ""), "d.png": ("image", "png"), "e.md": ("container", "markdown"), "f.tex": ("container", "latex"), "g.docx": ("container", "docx"), "h": ("unknown", ""),
        "i": ("container", "pdf"), "j.mp4": ("av", "mp4"), "k.html": ("container", "html"), "l.txt": ("text", ""), "m.txt": ("text", ""), "n.mp3": ("av", "mp3"),
    }
    assert rows["b.txt"].suspicious_total == 2 and [h.kind for h in rows["b.txt"].hits] == ["space", "zwj_family"]
    assert rows["c.txt"].error.startswith("refusing to treat c.txt as text: it looks like a PNG image") and rows["x/missing.bin"].error == "no content"
    assert rows["h"].notes == [reports.NOTES["unknown"]] and rows["d.png"].has_c2pa and rows["d.png"].confidences == ["confirmed"]
    assert rows["e.md"].findings == ["frontmatter key: generator", "frontmatter value hit on generator", "layer-a: U+200B U+200B ZERO WIDTH SPACE (Cf) x1 (zwj_family)"]
    assert [p for p, r in rows.items() if r.partial] == ["n.mp3"] and rows["m.txt"].suspicious_total == 0
    forced = {r.path: r.report for r in reports.inspect_files(files, forced="text", force_text=True).collect()}
    assert {r.kind for p, r in forced.items() if p != "x/missing.bin"} == {"text"}
    with pytest.raises(ValueError):
        reports.inspect_files(files, forced="sheet")


def test_one_file_never_fails_an_audit(monkeypatch):
    def broken(*_):
        raise RecursionError("too deep")

    monkeypatch.setattr(reports, "inspect_bytes", broken)
    assert reports.report_of("a.txt", b"x")["error"] == "RecursionError: too deep" and reports.report_of("a.txt", None)["error"] == "no content"


def test_verdicts(files):
    x = reports.styled(reports.inspect_files(files))
    rows = {r.path: (r.plain, r.styled) for r in x.select("path", reports.is_suspicious(F.col("report")).alias("plain"), reports.is_suspicious(F.col("report"), F.col("style_score")).alias("styled")).collect()}
    assert [p for p, (plain, _) in rows.items() if plain] == ["b.txt", "d.png", "e.md", "f.tex", "g.docx", "i"]
    assert [p for p, (plain, with_style) in rows.items() if with_style and not plain] == ["l.txt"]


def test_audit(files, spark, tmp_path):
    x = reports.styled(reports.inspect_files(files))
    items = reports.audit_items(x, style_col="style_score")
    rows = {r.path: r for r in items.collect()}
    assert rows["b.txt"].findings == ["layer-a [space] U+00A0 NO-BREAK SPACE (Zs) x1", "layer-a [zwj_family] U+200B ZERO WIDTH SPACE (Cf) x1"] and rows["b.txt"].confidence == ["informational", "probable"]
    assert rows["l.txt"].findings[0].startswith("stylometry [high_probability] score 0.") and rows["l.txt"].suspicious_total == 1
    assert {r.path for r in reports.audit_skipped(x).collect()} == {"c.txt", "x/missing.bin"}
    s = reports.audit_summary(items).first()
    assert (s.total, s.with_c2pa, s.with_suspicious_text) == (13, 2, 4) and s.by_kind["text"] == 4 and s.by_kind["docx"] == 1
    want = {"confirmed": 0, "probable": 0, "informational": 0, "likely_false_positive": 0}
    for r in rows.values():
        for c in r.confidence:
            want[c] += 1
    assert s.findings_by_confidence == want and s.actionable_files == sum(r.has_c2pa or bool({"confirmed", "probable"} & set(r.confidence)) for r in rows.values())
    none = reports.audit_summary(items.limit(0)).first()
    assert (none.total, none.by_kind) == (0, {})
    documents = reports.sarif_documents(items.withColumn("path", F.concat(F.lit("/root/x/"), "path")), root="/root/x").collect()
    sarif = json.loads(documents[0].value)
    results = sarif["runs"][0]["results"]
    assert len(documents) == 1 and sarif["version"] == "2.1.0" and len(results) == sum(len(r.findings) for r in rows.values())
    assert {"ruleId": "AI-WATERMARK-C2PA", "level": "error", "message": {"text": "PNG chunk caBX (possible C2PA container)"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "d.png"}}}]} in results
    lines = [json.loads(r.value) for r in reports.json_reports(x.select("path", "report")).collect()]
    assert "error" in lines[0]["report"] and len(lines) == 15
    folder = tmp_path / "build"
    folder.mkdir()
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    again = reports.audit_summary(reports.audit_items(reports.inspect_files(read_files(spark, str(folder))))).first()
    assert again.total == 13 and again.by_kind == s.by_kind


def test_text_audit(spark):
    df = spark.createDataFrame([("a", "x\u200by\u200b We delve into it. " * 20), ("b", "plain"), ("c", None)], "path string, text string")
    rows = reports.text_audit(df).collect()
    assert [(r.path, r.detector) for r in rows] == [("a", "unicode"), ("a", "stylometry")]
    assert rows[0].label == "U+200B ZERO WIDTH SPACE (Cf)" and rows[0]["count"] == 40 and rows[0].severity == "probable" and rows[0].samples is None
    assert rows[1].phrase == "delve into" and rows[1].samples == ["delve into"] * 3 and len(rows[1].spans) == 10 and rows[1].severity in ("high", "medium", "low")
    assert (rows[1].spans[0].start, rows[1].spans[0].end) == (8, 18)


def test_detectors(files):
    x = reports.detect(reports.inspect_files(files))
    rows = {r.path: (r.detections, r.positive) for r in x.select("path", "detections", reports.any_positive(F.col("detections")).alias("positive")).collect()}
    names = lambda p: [(d.detector, d.available) for d in rows[p][0]]
    assert names("a.txt") == [("markllm", False), ("gumbel", False), ("claude-text", False), ("stylometry", True)]
    assert names("d.png") == [("metadata", True), ("synthid", False)] and names("j.mp4") == [("metadata", True)] and names("h") == [] and rows["d.png"][0][0].has_c2pa
    assert [p for p, (_, positive) in rows.items() if positive] == ["l.txt"]
    keyed = {r.path: r.detections for r in reports.detect(reports.inspect_files(files), key="secret").select("path", "detections").collect()}
    assert keyed["a.txt"][1].available and keyed["a.txt"][1].is_watermarked is False and keyed["a.txt"][1].p_value == 1.0
