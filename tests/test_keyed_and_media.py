import hashlib
import hmac
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import keyed
from glyphlake.sources import binary
from glyphlake.sources.corpus import corpus_texts, read_files
from glyphlake.streaming.landing import audit_landing


def test_replay_golden():
    ids = [i.to_bytes(8, "big") for i in range(1, 7)]
    counted, repeated, statistic = keyed.replay(ids, keyed.key_bytes("secret"))
    assert (counted, repeated) == (2, 0) and statistic > 0
    assert keyed.replay(keyed.simple_tokens("one two"), b"k") == (0, 0, 0.0)
    assert keyed.replay([b"12345678"] * 9, b"k")[:2] == (1, 4)
    assert keyed.key_bytes("0x6162") == b"ab" and keyed.key_bytes("secret") == b"secret"


def test_token_ids(spark):
    one = (1).to_bytes(8, "big")
    assert keyed.token_ids("[1, 18446744073709551615]") == [one, b"\xff" * 8] == keyed.token_ids("1\n\n 0xFFFFFFFFFFFFFFFF\n")
    for bad in ("[1.5]", "[-1]", "[true]", '["1"]x', "[18446744073709551616]", "0x", "-1", "a", "[1] [2]"):
        with pytest.raises(ValueError):
            keyed.token_ids(bad)
    df = spark.createDataFrame([("[1,2,3,4,5,6]",), ("x",), (None,), ("7\n" * 9,)], "text string")
    rows = [r.replay for r in keyed.replay_test(df, "secret", ids=True).collect()]
    ids = [i.to_bytes(8, "big") for i in range(1, 7)]
    assert rows[0].counted == 2 and rows[0].statistic == pytest.approx(keyed.replay(ids, b"secret")[2], abs=1e-6) and rows[1] is None and rows[2].tokens == 0 and rows[3].counted == 1


def plain_replay(words, key, window=4):
    """Statistic and p-value from their definition, with every context spelled out."""
    tokens = [hashlib.sha256(w.encode()).digest()[:8] for w in words]
    seen, total, n = [], 0.0, 0
    for i in range(window, len(tokens)):
        context = tuple(tokens[i - window : i])
        if context not in seen:
            seen.append(context)
            seed = hmac.new(key, b"".join(context), hashlib.sha256).digest()
            draw = hmac.new(seed, tokens[i], hashlib.sha256).digest()
            total += -math.log(1 - (int.from_bytes(draw[:8], "big") + 0.5) / 2**64)
            n += 1
    below = sum(math.exp(-total) * total**k / math.factorial(k) for k in range(n))
    return n, total, below if n else 1.0


def test_replay_against_its_definition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(30)]
    for text, r in zip(texts, keyed.replay_test(spark.createDataFrame([(t,) for t in texts], "text string"), "secret").collect(), strict=True):
        n, total, p = plain_replay(text.split(), b"secret")
        assert (r.replay.counted, r.replay.statistic) == (n, pytest.approx(total, abs=1e-6)) and r.replay.p_value == pytest.approx(p, rel=1e-6)


def test_poisson():
    assert keyed.poisson_below(2.0, 1) == pytest.approx(0.1353352832)
    assert keyed.poisson_below(2.0, 3) == pytest.approx(0.6766764162)
    assert keyed.poisson_below(0, 3) == 1 and keyed.poisson_below(3, 0) == 1


def test_marked_text_is_found(spark):
    df = spark.createDataFrame([("one two",), (None,), ("a b c d e f g h",)], "text string")
    rows = [r.replay for r in keyed.replay_test(df, "secret").collect()]
    assert rows[0].p_value == 1.0 and not rows[0].is_watermarked and rows[1].tokens == 0 and rows[2].counted == 4
    with pytest.raises(ValueError):
        keyed.replay_test(df, "k", window=0)


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + b"\0\0\0\0" for k, b in chunks)


def test_walkers():
    assert [(p[2], p[3]) for p in binary.png_chunks(png((b"IHDR", b"x"), (b"tEXt", b"c2pa"), (b"IEND", b"")))] == [("IHDR", b"x"), ("tEXt", b"c2pa"), ("IEND", b"")]
    assert list(binary.png_chunks(png((b"IHDR", b"x"))[:-3]))[-1][5] == "truncated chunk"
    assert [p[2] for p in binary.jpeg_segments(b"\xff\xd8\xff\xe1\x00\x04ab\xff\xfe\x00\x03c\xff\xda")] == ["E1", "FE", "DA"]
    assert [p[2] for p in binary.riff_chunks(b"RIFF\0\0\0\0WEBPEXIF\x01\0\0\0a\0XMP \x02\0\0\0ab")] == ["EXIF", "XMP "]
    inner = struct.pack(">I4s", 12, b"c2pa") + b"abcd"
    boxes = struct.pack(">I4s", 8, b"ftyp") + struct.pack(">I4s", 8 + len(inner), b"moov") + inner
    assert [(p[2], p[4]) for p in binary.bmff_boxes(boxes)] == [("ftyp", ""), ("moov", ""), ("c2pa", "/moov")]
    tag = b"ID3\x03\0\0\0\0\0\x0dTIT2\0\0\0\x03\0\0abc"
    assert [(p[2], p[3], p[4]) for p in binary.id3_frames(tag)] == [("TIT2", b"abc", "2.3")]
    for walk in binary.WALKERS.values():
        for data in (b"", b"plain text that is no media"):
            assert all(part[5] for part in walk(data))


def test_walker_in_sql(spark):
    binary.register_walkers(spark)
    df = spark.createDataFrame([(1, bytearray(png((b"IEND", b"")))), (2, None)], "id int, content binary")
    assert [r.kind for r in spark.sql("SELECT c.kind FROM {d} d, LATERAL png_chunks(d.content) c", d=df).collect()] == ["IEND"]


def test_corpus_lines(spark):
    lines = ['{"text": "a"}', '{"other": 1}', " plain ", "", None, "{not json", '{"text": 5}', '{"text": {"x": 1}}', '{"text": null}', '{"text": ""}', '[{"text": "b"}]', '\t{"text": "c"} ']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.text for r in corpus_texts(df).collect()) == ['[{"text": "b"}]', "a", "c", "plain", "{not json"]


def test_a_root_may_have_any_name(spark, tmp_path):
    root = tmp_path / ".data" / "build"
    for name in ("a.txt", "vendor/b.txt", "build/c.txt", ".git/d.txt", "sub/.hidden/e.txt", "own/f.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    found = lambda **more: sorted(r.path.rpartition("build/")[2] for r in read_files(spark, str(root), **more).collect())
    assert found() == ["a.txt", "own/f.txt", "vendor/b.txt"]
    assert found(skipped=["own"]) == ["a.txt", "vendor/b.txt"]


def test_files_and_landing(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("x​y\nplain\n")
    (folder / "sub" / "b.txt").write_text("z" * 50)
    rows = {r.path.rpartition("/")[2]: r for r in read_files(spark, str(folder), max_bytes=20).collect()}
    assert rows["a.txt"].content is not None and rows["b.txt"].error == "too large"
    for late in ("b2.txt", None):
        audit_landing(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), max_bytes=20).awaitTermination()
        if late:
            (folder / late).write_bytes(b"\x89PNG\r\n\x1a\n")
    out = spark.read.parquet(str(tmp_path / "out")).select(F.regexp_extract("path", "([^/]+)$", 1).alias("f"), "suspicious_total", "error", "batch").collect()
    assert sorted((r.f, r.suspicious_total, r.batch) for r in out if not r.error) == [("a.txt", 1, 0)]
    assert sorted((r.f, r.batch) for r in out if r.error) == [("b.txt", 0), ("b2.txt", 1)]
