import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import arrays, evidence, style
from glyphlake.operators import ngrams


def test_style_golden():
    assert style.moving_diversity(["apple"] * 100) < 0.05
    assert style.moving_diversity([str(i) for i in range(100)]) == 1.0
    assert style.burstiness("one two three four five. one two three four five. one two three four five.") == 0
    assert style.burstiness("only one sentence here") is None
    assert style.words("élan vital ever-evolving it's") == ["élan", "vital", "ever-evolving", "it's"]


def test_style_score(spark):
    text = "We delve into this topic with careful context and practical examples. " * 12
    df = spark.createDataFrame([(1, text), (2, "a short note"), (3, None)], "id int, text string")
    x = style.style_measures(df)
    rows = {r.id: r for r in x.withColumns(style.style_score(F.col("style"))).collect()}
    assert rows[1].status == "ok" and rows[1].score >= 0.65 and rows[1].density_tier == "high"
    assert rows[2].status == "insufficient_length" and rows[2].score is None and rows[2].density_tier == "uncalibrated"
    assert rows[3].style.n_words == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("a b a b",), (None,), ("",)], "text string")
    got = {(tuple(r.ctx), r.tok): r.n for r in ngrams.context_counts(df, context=1).collect()}
    assert got == {(("a",), "b"): 2, (("b",), "a"): 1}
    row = spark.createDataFrame([("Hello, World! 3.5",)], "t string").select(ngrams.tokens(F.col("t")).alias("t")).first()
    assert row.t == ["hello", ",", "world", "!", "3", ".", "5"]


@pytest.mark.parametrize(("x", "y", "want"), [("a b c", "a b c", 0.0), ("a b", "", 1.0), ("", "", 0.0), ("a b c", "b c d", 1 - 1 / 3)])
def test_divergence(spark, x, y, want):
    row = spark.createDataFrame([(x, y)], "x string, y string").select(ngrams.bigram_divergence(F.col("x"), F.col("y")).alias("d")).first()
    assert row.d == pytest.approx(want)


def test_auroc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.2, 0), (0.9, 1), (None, 1)], "s double, y int")
    up = ngrams.auroc(df, "s", "y").first().auroc
    down = ngrams.auroc(df.withColumn("y", 1 - F.col("y")), "s", "y").first().auroc
    assert up == pytest.approx(3.5 / 4) and up + down == pytest.approx(1)
    assert ngrams.auroc(df.where("y = 1"), "s", "y").first().auroc is None


def test_image_format(spark):
    cases = {b"\x89PNG\r\n\x1a\nxx": "png", b"\xff\xd8\xff": "jpeg", b"GIF89a": "gif", b"RIFF\0\0\0\0WEBP": "webp", b"\0\0\0\x18ftypavif\0\0\0\0": "avif", b"\0\0\0\x18ftypheic\0\0\0\0": "heic", b"": "unknown", b"hello": "unknown"}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in cases.items()], "content binary, want string")
    for row in df.select("want", evidence.image_format(F.col("content")).alias("got")).collect():
        assert row.got == row.want


def test_html(spark):
    pages = ['<meta name="description" content="Claude Monet">', '<meta name="x" content="c2pa">', '<p data-ai-x="1">', None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    rows = {r.id: r for r in evidence.html_evidence(df).collect()}
    assert not rows[0].has_ai_metadata and rows[1].has_c2pa and rows[2].findings == ['attr: data-ai-x="1"'] and rows[3].findings == []


def test_data_uris_that_do_not_decode(spark):
    pages = ['<img src="data:image/png;base64,!!!">', '<img src="data:image/gif,%ZZ">', '<img src="data:image/png;base64,YzJwYQ==">', None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    rows = {r.id: r.u for r in df.select("id", evidence.data_uris(F.col("html")).alias("u")).collect()}
    assert rows[0][0].content is None and rows[1][0].content is None and bytes(rows[2][0].content) == b"c2pa" and rows[3] == [] and rows[4] == []


def test_sequence_scores(spark):
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, "x"), (3, None)], "doc_id long, text string")
    scorer = spark.createDataFrame([(["a", "b"], "c", 0.5)], "ctx array<string>, tok string, score double")
    rows = {r.doc_id: (r.score_sum, r.applied, r["mean"]) for r in ngrams.sequence_scores(docs, scorer).collect()}
    assert rows == {1: (1.0, 2, 0.5), 2: (0.0, 0, None), 3: (0.0, 0, None)}


def test_frontmatter(spark):
    texts = ["---\ntitle: x\nGenerator: Claude\nnote: made with C2PA\n---\nbody", "---\nauthor: Claude Monet\n---\n", "no front matter", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = {r.id: r for r in evidence.frontmatter(df).collect()}
    assert rows[0].ai_keys == ["Generator", "note"] and rows[0].findings[0] == "frontmatter key: Generator"
    assert rows[1].ai_keys == [] and rows[1]["keys"] == ["author"] and rows[2]["keys"] == [] and rows[3].ai_keys == []


def test_html_hidden_evidence(spark):
    import base64
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    uri = lambda raw, mime="png": f'<img src="data:image/{mime};base64,{base64.b64encode(raw).decode()}">'
    png = b"\x89PNG\r\n\x1a\n"
    packed = b"Software\0\0" + zlib.compress(b"made by Midjourney")
    pages = ["<p>&#99;2pa</p>", uri(png + chunk(b"caBX", b"")), uri(png + chunk(b"zTXt", packed)), "<p>a &amp; b</p>" + uri(png + chunk(b"tEXt", b"Title\0x")), "<p>c2pa &amp; b</p>", '<img src="data:image/svg+xml,%3Csvg%3E%3Cmetadata%3Ex%3C/metadata%3E">', uri(b"\xff\xd8\xff\xeb\0\4ab\xff\xd9", "jpeg"), None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    rows = {r.id: r for r in evidence.html_evidence(df).collect()}
    assert rows[0].has_c2pa and rows[0].findings == ["entity-encoded provenance markers: c2pa, C2PA, c2pa, C2PA"]
    assert rows[1].has_c2pa and rows[1].findings == ["embedded data:image/png: PNG chunk caBX (possible C2PA container)"]
    assert rows[2].has_ai_metadata and not rows[2].has_c2pa and rows[2].findings == ["embedded data:image/png: PNG zTXt: AI generator (Software=Midjourney)"]
    assert [rows[i].findings for i in (3, 4, 7)] == [[], [], []] and not rows[3].has_ai_metadata
    assert rows[5].has_ai_metadata and not rows[5].has_c2pa and rows[6].has_c2pa
    assert evidence.html_evidence(df.where("id = 4"), all_markers=True).first().has_c2pa
    assert {r.uri for r in evidence.sarif_results(evidence.html_evidence(df), "id").collect()} == {0, 1, 2, 5, 6}


def test_holdout(spark):
    ids = [(i * 7919) % 20011 for i in range(20000)]
    df = spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "doc_id long")
    cut = sorted(ids)[5999]
    got = [(r.doc_id, r.holdout) for r in ngrams.holdout(df, "doc_id").collect()]
    assert len(got) == 20002 and all(h == (i is not None and i <= cut) for i, h in got)
    assert ngrams.kth_key(df, "doc_id", 17, parts=3, least=10) == sorted(ids)[16]


def test_measures_of_many_texts(spark, monkeypatch):
    """Texts measured together, and those apart, against their definitions."""
    rng = random.Random(3)
    parts = ["a", "b", "Éa", "it's", "x-", "-y", "'", "_", "1", " ", "  ", "\n", "\n\n", ".", "...", "! ", "?", "foo bar. ", "baz ", "é", "漢", "qux", "Ab", " \n", "\t", "-", "''"]
    odd = ["```\n", "\u00a0", "\u03a3", "\u0130", "\x0b"]
    texts = ["".join(rng.choice(parts + (odd if i % 4 == 0 else [])) for _ in range(rng.choice([0, 3, 10, 60, 400]))) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000, None)], "id int, text string")
    rows = {r.id: r.style for r in style.style_measures(df).collect()}
    for i, text in enumerate(texts):
        n, k, diversity, cv = style.measures(text)
        got = rows[i]
        assert (got.n_words, got.n_sentences) == (n, k) and got.mattr == pytest.approx(diversity)
        assert got.burstiness_cv is None if cv is None else got.burstiness_cv == pytest.approx(cv)
    assert rows[1000].n_words == 0 and sum(rows[1000].hits) == 0
    monkeypatch.setattr(arrays, "STRETCH", 100)
    plain = [t.lower().rstrip() for i, t in enumerate(texts) if i % 4 and len(t.lower()) == len(t)]
    together = [np.concatenate(x) for x in zip(*style._many(plain), strict=True)]
    for i, text in enumerate(plain):
        n, k, diversity, _ = style.measures(text)
        assert (together[0][i], together[1][i]) == (n, k) and together[2][i] == pytest.approx(diversity)


def test_marker_spans(spark):
    df = spark.createDataFrame([("é We delve into it, and delve  INTO that.",), ("plain",), (None,)], "text string")
    rows = [r.markers for r in style.marker_matches(df).collect()]
    assert [(m.phrase, m["count"], m.samples, [(s.start, s.end) for s in m.spans]) for m in rows[0]] == [("delve into", 2, ["delve into", "delve  INTO"], [(5, 15), (24, 35)])] and rows[1:] == [[], []]
