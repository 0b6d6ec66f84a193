import gzip
import http.server
import json
import math
import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import evaluation
from glyphlake.operators.ngrams import skyline
from glyphlake.sources import web

QUALITY = "struct<lexical_divergence: double, semantic_divergence: double, length_ratio: double, numbers_preserved: double, tokens_in: long, tokens_out: long>"
ROWS = f"variant string, before_pos boolean, after_pos boolean, cleared boolean, robust_cleared boolean, noop boolean, score_before double, score_after double, margin double, seconds double, attempts double, usd double, ai_style_score double, quality {QUALITY}, notes array<string>, level double, semantic_divergence double, lexical_divergence double"


def result_rows(n=300):
    rng = random.Random(2)
    some = lambda f: f() if rng.random() < 0.8 else None
    flag = lambda: rng.random() < 0.5
    number = lambda: round(rng.random() * 10, 3)
    out = []
    for _ in range(n):
        quality = some(lambda: (number(), some(number), number(), number(), rng.randrange(100), rng.randrange(1, 100)))
        out.append((rng.choice(["a", "b", "c"]), flag(), flag(), some(flag), flag(), flag(), some(number), some(number), some(number), some(number), some(lambda: float(rng.randrange(3))), some(number), some(number), quality, some(lambda: rng.sample(["x", "y", "identical watermarked generation 1"], 2)), some(lambda: float(rng.randrange(4))), some(number), some(number)))
    return [*out, ("none", False, False, False, False, False, *[None] * 7, None, None, None, None, None)]


def test_medians_of_groups(spark):
    rng = random.Random(1)
    rows = [(k, round(rng.gauss(0, 5), rng.choice([0, 3]))) for k in ("a", "b", None) for _ in range({"a": 4001, "b": 2000}.get(k, 7))] + [("c", 1.5), ("d", None), ("e", 2.0), ("e", 2.0)]
    got = {r.k: (r.upper_median, r.true_median) for r in evaluation.grouped_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (sorted(v)[len(v) // 2], statistics.median(v)) for k, v in groups.items()}


def test_summaries(spark):
    rows = result_rows()
    names = [f.name for f in spark.createDataFrame([], ROWS).schema]
    df = spark.createDataFrame(rows, ROWS)
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    quality = ("lexical_divergence", "semantic_divergence", "length_ratio", "numbers_preserved", "tokens_in", "tokens_out")
    mean = lambda v, digits=4: round(sum(v) / len(v), digits) if v else None
    for r in evaluation.variant_summary(df).collect():
        g = [d for d in dicts if d["variant"] == r.variant]
        q = [dict(zip(quality, d["quality"], strict=True)) for d in g if d["quality"]]
        before = sum(d["before_pos"] for d in g)
        cleared = sum(bool(d["cleared"]) for d in g)
        deltas = [d["score_before"] - d["score_after"] for d in g if d["score_before"] is not None and d["score_after"] is not None]
        assert (r.n, r.before_positive, r.cleared) == (len(g), before, cleared)
        assert r.clear_rate == (pytest.approx(cleared / before, abs=1e-4) if before else None)
        assert r.median_score_delta == (pytest.approx(sorted(deltas)[len(deltas) // 2], abs=1e-4) if deltas else None)
        for name, values in (("mean_score_delta", deltas), ("mean_semantic_divergence", [x["semantic_divergence"] for x in q if x["semantic_divergence"] is not None]), ("mean_attempts", [d["attempts"] for d in g if d["attempts"] is not None])):
            assert getattr(r, name) == (pytest.approx(mean(values), abs=0.006) if values else None)
        assert r.est_usd == pytest.approx(sum(d["usd"] or 0 for d in g), abs=1e-5) and r.notes == sorted({n for d in g for n in d["notes"] or []})
        tokens = mean([x["tokens_out"] for x in q], 9)
        assert r.clears_per_mtok_out == (pytest.approx(cleared / before / (tokens / 1e6), rel=1e-6) if before and tokens else None)
    r = evaluation.minimal_summary(df).first()
    done = [d for d in dicts if d["cleared"] is not None]
    ok = [d for d in done if d["cleared"]]
    out = [d for d in dicts if d["cleared"] is None and not d["attempts"]]
    levels = [d["level"] for d in ok if d["level"] is not None]
    reasons = {}
    for d in out:
        for note in d["notes"] or []:
            reasons[note] = reasons.get(note, 0) + 1
    assert (r.n_samples, r.n_cleared, r.n_excluded, r.excluded_reasons) == (len(done), len(ok), len(out), reasons)
    assert r.median_min_level == statistics.median(levels) and r.level_usage == {x: levels.count(x) for x in set(levels)}
    assert r.n_duplicate_generations == sum(n.startswith("identical") for d in dicts for n in d["notes"] or [])
    assert r.median_min_semantic_divergence == pytest.approx(statistics.median([d["semantic_divergence"] for d in ok if d["semantic_divergence"] is not None]), abs=1e-4)
    none = evaluation.minimal_summary(df.limit(0)).first()
    assert none.n_samples == 0 and none.median_min_level is None and not none.level_usage


def test_frontier(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(12)), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, up double, down double, more double").repartition(7)
    full = [r for r in rows if r[3] is not None]
    beats = lambda b, a: b[1] >= a[1] and b[2] <= a[2] and b[3] >= a[3] and b[1:] != a[1:]
    assert sorted(r.id for r in skyline(df, "id", ["up", "more"], ["down"]).collect()) == sorted(a[0] for a in full if not any(beats(b, a) for b in full))
    assert skyline(df.limit(0), "id", ["up"], ["down"]).count() == 0


def test_ranking_and_verdicts(spark):
    rows = [("a", 0.9, 0.2, 0.5, 0.1), ("b", 0.8, 0.1, 0.6, 0.9), ("c", 0.7, 0.3, 0.4, 0.9), ("d", None, 0.0, 1.0, 1.0), ("e", 0.2, 0.0, 0.9, None)]
    df = spark.createDataFrame(rows, "id string, robust_clear_rate double, sem_div double, human_like double, holdout_robust_clear_rate double")
    ids = lambda **more: [r.id for r in evaluation.ranked_on_frontier(df, "id", (0.5, 0.3, 0.2), **more).collect()]
    assert ids() == ["b", "a", "e"] and ids(coverage_floor=0.5) == ["b", "a"] and ids(coverage_floor=0.5, prefer_holdout=True) == ["b"]
    rates = spark.createDataFrame([(None,), (0.0,), (0.5,), (1.0,)], "r double")
    assert [r.v for r in rates.select(evaluation.verdict(F.col("r")).alias("v")).collect()] == ["undetermined", "resists", "partial", "removable"]


def test_pairs_and_counters(spark):
    df = spark.createDataFrame([("abcd" * 5, "ab", [1.0, 0.0], [0.0, 2.0]), ("", "x", [1.0, 1.0], [2.0, 2.0]), ("a", "", [0.0, 0.0], [1.0, 1.0]), ("a", "b", [1.0], [1.0, 2.0])], "a string, b string, x array<float>, y array<float>")
    out = df.select(evaluation.token_estimate(F.col("a")).alias("t"), evaluation.length_ratio(F.col("a"), F.col("b")).alias("r"), evaluation.semantic_divergence(F.col("x"), F.col("y")).alias("d")).collect()
    assert [r.t for r in out] == [5, 1, 1, 1] and [r.r for r in out] == [0.1, 1.0, 0.0, 1.0]
    assert out[0].d == 1.0 and abs(out[1].d) < 1e-12 and out[2].d is None and out[3].d is None
    refs = spark.createDataFrame([("f", "a.xml"), ("f", "gone.xml"), ("g", "a.xml")], "file string, target string")
    members = spark.createDataFrame([("f", "a.xml")], "file string, name string")
    assert sorted(map(tuple, evaluation.dangling(refs, members, ["file"], "target", "name").collect())) == [("f", "gone.xml"), ("g", "a.xml")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://Ex.COM/a", ("https", "ex.com", 443)), ("http://ex.com.:8080?x#y", ("http", "ex.com", 8080)), ("http://ex.com:", ("http", "ex.com", 80)), ("HTTP://[::1]:81/", ("http", "::1", 81)), ("http://[::1]/", ("http", "::1", 80)),
        ("ftp://ex.com", None), ("http://u:p@ex.com", None), ("http:///x", None), ("http://ex.com:0", None), ("http://ex.com:70000", None), ("http://ex.com:x", None), ("nothing", None), (None, None),
    ],
)
def test_origins(spark, url, want):
    r = spark.createDataFrame([(url,)], "url string").select(web.origin(F.col("url")).alias("o")).first().o
    assert (tuple(r) if r else None) == want


def test_addresses():
    public = ["8.8.8.8", "1.1.1.1", "2606:4700::1111", "::ffff:8.8.8.8", "198.20.0.1", "100.128.0.1"]
    refused = ["10.1.2.3", "172.31.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "0.0.0.0", "224.0.0.1", "255.255.255.255", "240.0.0.1", "100.64.0.1", "192.0.0.8", "192.0.2.1", "198.18.5.5", "198.19.5.5", "198.51.100.7", "203.0.113.9", "::", "::1", "fe80::1", "fc00::1", "ff02::1", "2001:db8::1", "2001:1f::1", "::ffff:10.0.0.1", "", "x", None]
    assert all(map(web.is_public, public)) and not any(map(web.is_public, refused))


def sitemap(root, *locations):
    return f"<?xml version='1.0'?><{root} xmlns='http://s'>{''.join(f'<x><loc> {u} </loc></x>' for u in locations)}</{root}>".encode()


def test_sitemaps(spark):
    assert web.parse_sitemap(gzip.compress(sitemap("urlset", "http://a/b?x&amp;y"))) == ("urlset", ["http://a/b?x&y"])
    for bad in (b"", b"<a", b"<!DOCTYPE x><a/>", b"\x1f\x8bxx", b"<a><!ENTITY b></a>"):
        with pytest.raises(ValueError):
            web.parse_sitemap(bad)
    site = "http://ex.com"
    fetched = {
        "/sitemap_index.xml": sitemap("sitemapindex", f"{site}/1.xml", f"{site}/2.xml", f"{site}/1.xml"),
        "/1.xml": sitemap("urlset", f"{site}/p1", f"{site}/p2"),
        "/2.xml": gzip.compress(sitemap("sitemapindex", f"{site}/3.xml")),
        "/3.xml": sitemap("urlset", f"{site}/p2", "https://ex.com/p3", f"{site}/p4"),
        "/robots.txt": b"User-agent: *\r\nSITEMAP: http://ex.com/1.xml\r\n",
        "/sitemap.xml": b"<html>not found",
    }
    df = spark.createDataFrame([(site + p, bytearray(c)) for p, c in fetched.items()], "url string, content binary")
    start = web.discover_sitemap(df, f"{site}/")
    assert start == f"{site}/sitemap_index.xml" and web.discover_sitemap(df.where("url like '%robots.txt'"), site) == f"{site}/1.xml" and web.discover_sitemap(df.limit(0), site) is None
    pages = lambda **more: [r.url for r in web.site_pages(df, start, **more).orderBy("rank").collect()]
    assert pages() == [f"{site}/p1", f"{site}/p2", "https://ex.com/p3", f"{site}/p4"] and pages(max_pages=2) == [f"{site}/p1", f"{site}/p2"]
    for rows in ([(start, sitemap("urlset", "http://other.com/x"))], [(start, sitemap("sitemapindex", f"{site}/missing.xml"))], [(start, b"<a")]):
        with pytest.raises(ValueError):
            web.site_pages(spark.createDataFrame([(u, bytearray(c)) for u, c in rows], "url string, content binary"), start).count()


@pytest.mark.parametrize(
    ("url", "data", "kind", "want"),
    [
        ("", b"", "TEXT/HTML; charset=x", "html"), ("x.png", b"", "image/jpeg", "jpeg"), ("http://a/x.MOV?q=1", b"", "", "mp4"), ("", b"\x89PNG", "application/x", "png"), ("", b"RIFF0000WEBP", "", "webp"),
        ("", b"\0\0\0\x0cftypmif1", "", "heic"), ("", b"\0\0\0\x0cftypisom", "", "mp4"), ("", b"PK no zip", "", "text"), ("", b" <?xml?><svg>", "", "svg"), ("", b"x<HTML>", "", "html"), ("", b"plain", "", "text"), ("http://[bad", b"<a>", "", "html"),
    ],
)
def test_remote_kinds(url, data, kind, want):
    assert web.guess_kind(url, data, kind) == want


def test_paged_rows(spark, tmp_path):
    texts = [f"text {i}" + "x" * (i % 7) for i in range(230)]
    asked, waits = [], []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlsplit

            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append((int(q["offset"]), int(q["length"]), self.headers.get("Authorization")))
            if len(asked) == 2:
                self.send_response(503)
                self.send_header("Retry-After", "1")
                self.end_headers()
                return
            self.send_response(200 if q["dataset"] == "d" else 404)
            self.end_headers()
            at = int(q["offset"])
            self.wfile.write(json.dumps({"rows": [{"row": {"text": t}} for t in texts[at : at + int(q["length"])]]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    fetch = web.http_page(base, "secret", dataset="d")
    read = lambda offset: list(web.page_texts(web.page_with_retries(fetch, offset, 100, waits.append), "text", 7, 9))
    first = read(0) + read(100)
    assert first == [t for t in texts[:200] if 7 <= len(t) <= 9] and waits == [1.0] and asked[0] == (0, 100, "Bearer secret")
    with pytest.raises(web.Refused):
        web.page_with_retries(web.http_page(base, dataset="other"), 0, 1)
    with pytest.raises(ValueError):
        web.http_page("file:///etc")
    busy = lambda offset, length: (_ for _ in ()).throw(web.Busy("down", 0.0))
    waits.clear()
    with pytest.raises(RuntimeError):
        web.page_with_retries(busy, 0, 1, waits.append)
    assert waits == [2, 4, 8, 16, 32, 64, 90]
    assert [web._seconds(x) for x in ("0.1", "500", "x", None, "nan")] == [1.0, 120.0, 0.0, 0.0, 0.0] and math.isclose(web._seconds("7"), 7)
    # The stream reads page by page and goes on where its checkpoint says.
    spark.dataSource.register(web.PagedRows)
    for rows in (120, 230):
        stream = spark.readStream.format("paged_rows").options(base=base, dataset="d", rows=rows).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(texts[:rows])
    server.shutdown()
