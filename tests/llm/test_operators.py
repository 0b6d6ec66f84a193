"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "re", "th", "ti", "ou", "é", "X", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = make(20), make(80)
    texts = [make(rng.choice([1, 3, 4, 5, 12, 13, 40, 90])) for _ in range(n)]
    texts += [base, base.replace(" ", "\n", 3), " ".join(base.split()[:-1] + ["odd"]), passage, make(30) + " " + passage + " " + make(4), passage + " " + make(20)]
    texts += [None, "", " \t\n", "one", base, base, "a " * 40, make(4000), "\x0b".join(base.split())]
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string, lang string, secrets int, language int, n_words int, row int, tag string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], 1, 2, 3, 4, "x") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(docs, empty):
    from glyphlake.llm.jaccard_join import ngram_jaccard_join

    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    links = {i: sum(j != i and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    assert {r.doc_id: (r.component_id, r.n_links) for r in ngram_jaccard_join(docs, with_links=True).collect()} == {i: (root[i], links[i]) for i in sets}
    assert ngram_jaccard_join(empty).count() == 0


def test_jaccard_large_groups_and_null_ids(spark, monkeypatch):
    from glyphlake.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "GROUP_HASHES", 400)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "lonely words here"), (7, texts[7])]
    got = jaccard_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], least[root[i]]) for i in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    links = [sum(j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(len(rows))) for i in range(len(rows))]
    counted = jaccard_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), with_links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in counted), key=str) == sorted(((rows[i][0], links[i]) for i in range(len(rows))), key=str)


def test_jaccard_common_passage_makes_no_candidates(spark, monkeypatch):
    """A passage that many documents hold, but no task often, stays out of the prefixes."""
    from glyphlake.llm import jaccard_join

    edges, real = [], jaccard_join.connected_components

    def components(df, scratch):
        edges.append(df.count())
        return real(df, scratch)

    monkeypatch.setattr(jaccard_join, "connected_components", components)
    passage = " ".join(f"p{i}" for i in range(10))
    rows = [(i, " ".join([*(f"d{i}x{j}" for j in range(25)), passage, *(f"d{i}y{j}" for j in range(25))])) for i in range(450)]
    rows += [(450, rows[3][1] + " more"), (451, rows[3][1])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 226), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.ngram_jaccard_join(docs).collect()}
    assert got == {i: 3 if i > 449 else i for i in range(452)}
    assert edges[0] == 1  # of the two texts that are near


def brute_dedup(rows, window=13):
    first, out = {}, {}
    words = {i: WORDS.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    from glyphlake.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_dedup(corpus())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_backward_search():
    """Intervals of the index against counting, and window owners against a dictionary."""
    from glyphlake.llm.substring_dedup import FmIndex, window_owners

    rng = random.Random(6)
    for alphabet in (2, 5, 60):
        codes = np.array([rng.randrange(1, alphabet + 1) if rng.random() < 0.95 else 0 for _ in range(400)] + [0])
        index = FmIndex(codes, 4, np.arange(len(codes)))
        for _ in range(60):
            at = rng.randrange(396)
            pattern = codes[at : at + rng.randrange(1, 5)]
            if not pattern.all():  # separators are in no pattern
                continue
            lo, hi = index.before[pattern[-1]], index.before[pattern[-1] + 1]
            for symbol in pattern[-2::-1]:
                lo, hi = index.step(np.array([symbol, symbol]), np.array([lo, hi]))
            want = [i for i in range(len(codes) - len(pattern) + 1) if (codes[i : i + len(pattern)] == pattern).all()]
            assert sorted(index.values[lo:hi].tolist()) == want
    sizes = np.array([rng.randrange(3, 30) for _ in range(40)])
    words = np.array([rng.randrange(3) for _ in range(sizes.sum())], np.uint64)
    lows = np.array([rng.randrange(100) for _ in sizes])
    owner, cut = window_owners(words, sizes, lows, 3)
    first, begin = {}, np.concatenate(([0], np.cumsum(sizes)))
    windows = [[tuple(words[begin[f] + i : begin[f] + i + 3].tolist()) for i in range(n - 2)] for f, n in enumerate(sizes.tolist())]
    for f, own in enumerate(windows):
        for w in own:
            first[w] = min(first.get(w, 1000), int(lows[f]))
    assert [owner[cut[f] : cut[f + 1]].tolist() for f in range(40)] == [[first[w] for w in own] for own in windows]


def test_substring_dedup_rows(docs, spark):
    from glyphlake.llm.substring_dedup import substring_dedup

    for r in substring_dedup(docs, with_rows=True).collect():
        assert r.row.tag == "x" and r.row.doc_id == r.doc_id
        if r.kept_text is not None:
            assert hashlib.sha256(" ".join(WORDS.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256
    text = " ".join(f"w{i}" for i in range(20))
    rows = substring_dedup(spark.createDataFrame([(None, text), (5, text), (5, text), (6, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("5", 0), ("5", 0), ("6", 20), ("None", 0)]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers
    from glyphlake.llm.packing import pack_documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pack_documents(docs, length=256).collect()
    want = {}
    for i, t in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, p] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 256) + 2
    assert pack_documents(empty).count() == 0


def test_token_pieces_match_the_tokenizer():
    import glyphlake.llm.packing as packing
    from glyphlake.llm import kernel
    from glyphlake.llm.tokens import PieceIds

    tokenizer, encode = packing._encoder("word_bpe_49k.json")
    known = PieceIds(encode, most=500)
    rng = random.Random(2)
    alphabet = list("aA'sT té́eİI.,≮#1 2\n\x85\u00a0\u3000ßΣxK_-\x01|") + ["'s", "'LL", "<|endoftext|>", "İ"]
    texts = ["".join(rng.choice(alphabet[:-2]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for block in kernel.blocks(pa.array(texts)):
        start, end, offs = packing._piece_bounds(block)
        ids, size = known.lookup(packing._lowered(block.buf), start, end)
        cut = np.concatenate(([0], np.cumsum(kernel.fold(size, offs))))
        for i in range(block.n):
            assert ids[cut[i] : cut[i + 1]].tolist() == tokenizer.encode(texts[block.first + i], add_special_tokens=False).ids


PARTS = ["a", "e", "in", "the", " ", "  ", "s", "ing", "\n", "▁", "é", "🙂", "🙃🙂", "1", "00", "ion", "aaaa", "th", "==", "\t", "漢", "字"]


def plain_viterbi(model, word):
    """The best total score of any segmentation, with no sharing and no trie."""
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            score = model.score.get(piece, model.unknown_score if end - start == 1 else -math.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def unigram_model(bytes_too):
    """The public pieces as a unigram model with scores by rank, with or without bytes for unknown characters."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = pb.ModelProto.FromString(file.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = bytes_too
    for i, p in enumerate(model.pieces):
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -math.log(2 + i) if p.piece.strip("▁") else -11
        if not bytes_too and (p.type == pb.ModelProto.SentencePiece.BYTE or p.piece in ("1", "▁1")):
            p.type = pb.ModelProto.SentencePiece.UNUSED
    return model.SerializeToString()


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram with unknowns"])
def test_viterbi(kind):
    import public_tokenizers
    import sentencepiece
    from glyphlake.llm.sentencepiece_codec import SentencePieceModel

    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(500)]
    if kind == "bpe":
        model = SentencePieceModel.load("piece_bpe_32k.model")
        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    else:
        data = unigram_model(kind == "unigram")
        model, library = SentencePieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    total = lambda parts: sum(model.score.get(p, model.unknown_score) for p in parts)
    words = [w for t in texts for w in model.words(t)]
    for word, parts in zip(words, model.segment(words), strict=True):
        assert "".join(parts) == word and math.isclose(total(parts), plain_viterbi(model, word), abs_tol=1e-6)
    different = 0
    for text in texts:
        ids = model.encode(text)
        if model.byte:
            assert model.decode(ids) == text.replace("▁", " ")
        if model.bpe:
            assert model.merge(text) == library.encode(text)
            assert model.decode(model.merge(text)) == library.decode(library.encode(text))
        elif ids != library.encode(text):  # a tie, which the library's single precision settles
            different += 1
            assert math.isclose(sum(library.get_score(i) for i in ids), sum(library.get_score(i) for i in library.encode(text)), rel_tol=1e-5)
    assert different <= 3


def test_sentencepiece(docs, empty, spark):
    import public_tokenizers
    import sentencepiece
    from glyphlake.llm.sentencepiece_codec import SentencePieceModel, sentencepiece_decode, sentencepiece_encode

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = SentencePieceModel.load("piece_bpe_32k.model")
    out = sentencepiece_encode(docs)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for r in sentencepiece_decode(out.select("text", "pieces.*"), ids_col="ids", out_col="back").collect():
        text = r.text or ""
        assert r.ids == model.encode(text) and r.n_ids == len(r.ids) and r.ids_crc32 == crc(r.ids)
        assert r.bpe_ids == library.encode(text) and r.bpe_n_ids == len(r.bpe_ids) and r.bpe_ids_crc32 == crc(r.bpe_ids)
        assert r.round_trip and r.bpe_round_trip and (r.back or "") == text
    odd = spark.createDataFrame([("a ▁mark of its own", 1), ("a ▁mark of its own", 1), (None, 1)], "text string, pieces int")
    rows = sentencepiece_encode(odd, with_ids=False).collect()
    assert [r.pieces.n_ids for r in rows] == [len(model.encode(odd.first().text))] * 2 + [0] and not rows[0].pieces.round_trip and rows[0].pieces.ids is None
    assert rows[0].pieces.bpe_n_ids == len(library.encode(odd.first().text))
    assert sentencepiece_encode(empty).count() == 0
    ids = spark.createDataFrame([([None, 10**6, 264, 1],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in sentencepiece_decode(ids).collect()] == [model.decode([264, 1]), None, ""]


def test_url_trie(spark):
    from glyphlake.llm.queries import URL_RULES
    from glyphlake.llm.url_filter import UrlTrie, split_url, url_filter

    trie = UrlTrie(URL_RULES)
    rng = random.Random(3)
    for _ in range(3000):
        host = ".".join(rng.choice(["a", "example", "com", "net", "org", "xcom", ""]) for _ in range(rng.randrange(1, 4)))
        path = "".join(rng.choice(["/", "en", "de", "es", "7", "8", "x"]) for _ in range(rng.randrange(6)))
        path = path and "/" + path
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert trie.longest(host, path) == (max(fits, key=lambda r: len(r.host + r.path)) if fits else None)
    assert split_url("HTTP://A.Com/P?x#y") == ("a.com", "/P") and split_url("x") == ("", "") and split_url("a://b#c/d") == ("b", "")
    df = spark.createDataFrame([(1, "http://m.example.com/en/7", "old"), (2, None, "old"), (3, "", "old")], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_filter(df, URL_RULES).collect()}
    assert rows[1].verdict == "allow" and rows[1].rule == "example.com/en/7" and rows[2].host == "" and rows[3].rule is None


def test_secrets(spark):
    from glyphlake.llm.secrets import secret_scan

    key = "xK9pQ2vL7mZ4tR8wB3nY6cF1"
    texts = [f'api_key = "{key}" and AKIA{"A1" * 10} {"ab12" * 8}', "secret = token: abcdefgh", None, "", "the password is long", f"look {key} here", "camelCaseIdentifierWithManyWords2", "123e4567-e89b-12d3-a456-426614174000"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    rows = {r.doc_id: r.secrets for r in secret_scan(df).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 1, 1) and key not in rows[0].redacted and "api_key" in rows[0].redacted
    assert (rows[1].n_assign, rows[1].spans) == (0, "")  # the failing match takes its text with it
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].spans == "" and rows[4].redacted is None
    assert rows[5].n_random == 1 and rows[5].spans == f"random:5:{5 + len(key)}"
    assert rows[6].n_random == 0 and rows[7].n_random == 0


def test_odd_rows(spark, empty):
    """Repeated rows, empty tables and very long texts of the narrow operators."""
    from glyphlake.llm.quality_classifier import score_quality, train_quality_model
    from glyphlake.llm.queries import URL_RULES
    from glyphlake.llm.secrets import secret_scan
    from glyphlake.llm.url_filter import url_filter

    urls = spark.createDataFrame([(1, "http://a.com/en/" + "x/" * 100_000)] * 2, "page_id long, url string")
    assert [(r.verdict, r.rule, len(r.path)) for r in url_filter(urls, URL_RULES).collect()] == [("block", "com/en/", 200_004)] * 2
    assert url_filter(urls.limit(0), URL_RULES).count() == 0
    key = "xK9pQ2vL7mZ4tR8wB3nY6cF1"
    texts = spark.createDataFrame([(1, "words " * 300_000 + key)] * 2, "doc_id long, text string")
    assert [r.secrets.spans for r in secret_scan(texts).collect()] == [f"random:1800000:{1800000 + len(key)}"] * 2
    assert secret_scan(empty).count() == 0
    rows = [(i, ("good clean words " if i % 2 else "zzz qqq xxx ") * 3) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 0), (3, None), (5, 7)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows * 2 + [(21, None), (21, "")], "doc_id long, text string")
    model = train_quality_model(docs, labels, F.lit(True))
    scores = [(r.doc_id, r.quality_score) for r in score_quality(docs, model).collect()]
    assert len(scores) == 42 and all((s > 0.5) == (i % 2 == 1) for i, s in scores if i < 20) and scores[-1][1] == scores[-2][1]
    assert score_quality(empty, model).count() == 0
    small = train_quality_model(docs, labels, F.lit(True), max_bytes=1)  # one id is learned whatever its size
    assert len({s for _, s in ((r.doc_id, r.quality_score) for r in score_quality(docs, small).collect())}) == 1


def test_random_strings():
    import random
    import string

    from glyphlake.llm.secrets import TokenEfficiency, base_spans, redact

    test, draw = TokenEfficiency("byte_bpe_50k.tiktoken", 2.0), random.Random(7)
    found = lambda text: [text[a:b] for a, _, b in test.spans(text, base_spans(text))]
    some = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    for chars, n, least in [(string.ascii_letters, 32, 190), (string.ascii_uppercase + "234567", 32, 190), (string.ascii_letters + string.digits, 16, 180), (string.ascii_letters + string.digits, 19, 180)]:
        assert sum(found(f"look {s} here") == [s] for s in (some(chars, n) for _ in range(200))) >= least
    key, uuid, digest = "xK9pQ2vL7mZ4tR8wB3nY6cF1", "123e4567-e89b-12d3-a456-426614174000", "0F" * 16
    assert found("/home/user/documents/projects/settings/production/internationalization/documentation/configuration/" * 2 + key) == [key]
    assert found(f"{'ab12' * 8}/{key}") == [f"/{key}"]  # behind a known digest that is a base span too
    parts = ["xK9pQ2vL7mZ4tR8wB3nY6cF", "ab12cd34ef56ab12cd34ef56", "Zk8QwP3xR7tY2uN5"]
    text = f"see {''.join(parts)} and {parts[1]}"
    spans = sorted(base_spans(text) + test.spans(text, base_spans(text)))
    assert [k for _, k, _ in spans] == [3, 2, 2] and redact(text, spans, "#") == "see # and #"  # the base spans stay beside it
    assert found("2024-01-01-2023-04-05 1234-5678-1234-5678 " + string.ascii_uppercase + string.ascii_lowercase) == []
    assert found(f"{uuid} /users/{uuid}/profile {digest} integrity=sha256-{'aB3+x' * 8}aB3=") == []
    assert found("internationalization snake_case_identifier_name2 /usr/local/share/documentation camelCaseIdentifierWithManyWords2 " + "-" * 40) == []


def test_quality_rules(docs, empty):
    from glyphlake.llm.quality_rules import quality_rules

    texts = dict(corpus())
    for r in quality_rules(docs).collect():
        text = texts[r.doc_id] or ""
        w = WORDS.findall(text)
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        mark = [False] * len(w)
        for at in seen.values():
            for i in at if len(at) > 1 else []:
                mark[i : i + 5] = [True] * 5
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        rules = r.rules
        assert (rules.n_words, rules.word_chars, rules.n_repeat_words, rules.n_dup_lines) == (len(w), sum(map(len, w)), sum(mark), len(lines) - len(set(lines)))
        assert rules.base_failed == (len(w) < 10 or 100 * sum(mark) > 20 * len(w)) and not (rules.base_failed and rules.kept)
    assert quality_rules(empty).count() == 0


def test_quality_rules_method(spark, empty):
    """Covered characters and the longest repeat against brute force, on texts that the base rules pass."""
    from glyphlake.llm.quality_rules import quality_rules

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}é" for _ in range(n)]
    passage, short = words(30), words(6)
    texts = [" ".join(words(300) + passage + words(200) + passage + words(40)), " ".join(words(300) + short + words(200) + short), " ".join(words(90) + ["extraordinarily" * 9] * 5 + words(90) + ["extraordinarily" * 9] * 5), " ".join(words(60))]
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5)], "doc_id long, text string, rules int")).collect()}
    for i, text in enumerate(texts):
        w = WORDS.findall(text)
        longest, under = 0, [False] * len(w)
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                n = 0
                while b + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                longest = max(longest, n)
                if n >= 5:
                    under[a : a + n] = under[b : b + n] = [True] * n
        rules = rows[i].rules
        assert rules.longest_repeat == longest and rules.n_symbols == 0 and not rules.base_failed
        assert rules.covered_fraction == pytest.approx(sum(len(x) for x, u in zip(w, under, strict=True) if u) / sum(map(len, w)))
    assert [rows[i].rules.kept for i in range(4)] == [False, True, False, True]
    assert quality_rules(empty).count() == 0


def test_repeats_against_brute_force():
    from glyphlake.llm.quality_rules import repeat_lengths

    rng = random.Random(3)
    for _ in range(150):
        parts = [[rng.randrange(3 if rng.random() < 0.5 else 12) for _ in range(rng.choice([0, 1, 2, 5, 17, 40]))] for _ in range(4)]
        offs = np.cumsum([0, *map(len, parts)])
        want = []
        for d in parts:
            for i in range(len(d)):
                common = lambda j: next((k for k in range(len(d)) if max(i, j) + k >= len(d) or d[i + k] != d[j + k]), 0)  # noqa: B023, E731
                want.append(max((common(j) for j in range(len(d)) if j != i), default=0))
        assert repeat_lengths(np.array([x for d in parts for x in d], np.uint64), offs).tolist() == want


def code_length(samples, text):
    """PPM with method C and full exclusion, from its definition."""
    counts = [{} for _ in range(4)]
    for t in samples:
        padded = b"\xff\xff\xff" + t
        for i in range(3, len(padded)):
            for order in range(4):
                after = counts[order].setdefault(padded[i - order : i], {})
                after[padded[i]] = after.get(padded[i], 0) + 1
    padded, bits = b"\xff\xff\xff" + text, 0.0
    for i in range(3, len(padded)):
        excluded = set()
        for order in (3, 2, 1, 0):
            after = {s: c for s, c in counts[order].get(padded[i - order : i], {}).items() if s not in excluded}
            if not after:
                continue
            whole = sum(after.values()) + len(after)
            if padded[i] in after:
                bits += math.log2(whole / after[padded[i]])
                break
            bits += math.log2(whole / len(after))
            excluded |= set(after)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_code_lengths_against_brute_force(monkeypatch, stretch):
    from glyphlake.llm import language_id

    monkeypatch.setattr(language_id, "_STRETCH", stretch)
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n))).encode()
    samples = {"a": [draw("abcde  ", 60) for _ in range(8)], "b": ["hello there été ".encode() * 3, b"", b"x"], "c": []}
    texts = [draw("abcdefgh é", 50) for _ in range(40)] + [b"", b"h", b"hello"]
    model = language_id.PpmModel(samples)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = [[code_length(samples[x], t) for x in model.languages] for t in texts]
    for _ in range(2):  # worked out, then looked up
        assert np.allclose(model.bits(np.frombuffer(b"".join(texts), np.uint8), offs), want, atol=1e-3)


def test_language(docs, empty, spark):
    from glyphlake.llm.language_id import PpmModel, identify_language, train_language_model

    model = PpmModel({"de": [b"der die das und ist nicht ein eine " * 5], "en": [b"the and of to in is that it was for " * 5]})
    df = spark.createDataFrame([(1, "und das ist die", 7), (2, "it was the and", 7), (3, None, 7), (4, "12 !!", 7), (5, "", 7), (1, "und das ist die", 7), (6, "it was the and " * 200_000, 7)], "doc_id long, text string, language int")
    got = identify_language(df, model).collect()
    rows = {r.doc_id: r.language for r in got}
    assert len(got) == 7 and [rows[i].lang_pred for i in range(1, 7)] == ["de", "en", "und", "und", "und", "en"] and rows[1].score > 0.9 and rows[3].score == 0
    nothing = train_language_model(empty, F.lit(True))
    assert {r.language.lang_pred for r in identify_language(docs, nothing).collect()} == {"und"}
    assert identify_language(empty, model).count() == 0


def test_every_labelled_language_is_learned(spark):
    from glyphlake.llm.language_id import train_language_model

    rows = [(1, f"hier ist ein text nummer {i % 3}", "de") for i in range(3000)]  # many rows of one id
    rows += [(2, "the same words over and over " * 4000, "en"), (None, "no id", "xx"), (3, None, "yy"), (4, "", "zz"), (5, "no language", None)]
    rows += [(100 + i, f"word{i} " * 3, f"l{i:03}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(df, F.lit(True))
    assert model.languages == sorted(["de", "en"] + [f"l{i:03}" for i in range(100)])
    assert model.trees[model.languages.index("de")].contexts[0][1][0] == 3 * len("hier ist ein text nummer 0")  # copies teach once
    assert model.trees[model.languages.index("en")].contexts[0][1][0] == 50_000


def test_language_stage_rejects_strange_texts(spark):
    import random
    import string

    import corpus_pipeline

    draw, sf = random.Random(3), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = ["".join(draw.choice(string.ascii_lowercase + "   ") for _ in range(n)) for n in (60, 300, 2000)]
    strange += ["Gdzie jest najbliższa stacja kolejowa, bo muszę jutro rano pojechać do Krakowa na spotkanie z przyjaciółmi. " * 3, "Это русский текст о погоде и о людях"]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(more), sf)
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert kept.count() >= 0.98 * docs.where("text rlike '[a-z]'").count()


def test_pipeline_language_model_counts_all_texts(spark, monkeypatch):
    from glyphlake.llm import language_id

    words = ["alpha", "beta", "gamma", "delta", "épsilon"]
    texts = [f"{words[i % 5]} {i} {words[i % 3]}" for i in range(1200)] + ["long " * 30_000]
    rows = [(i, t, "xx" if i % 2 else "yy") for i, t in enumerate(texts)] + [(5000 + i, texts[0], "yy") for i in range(50)]
    df = spark.createDataFrame([*rows, (None, "no id", "zz"), (9000, "no language", None)], "doc_id long, text string, lang string").repartition(5)
    model = language_id.count_language_model(df, F.lit(True))
    whole = language_id.PpmModel({lang: [t.encode() for i, t in enumerate(texts) if i % 2 == odd] for lang, odd in (("xx", 1), ("yy", 0))})
    assert model.languages == whole.languages
    for one, other in zip(model.trees, whole.trees, strict=True):
        for x, y in zip([*one.runs, *one.contexts], [*other.runs, *other.contexts], strict=True):
            assert all(np.array_equal(a, b) for a, b in zip(x, y, strict=True))
    monkeypatch.setattr(language_id, "MAX_RUNS", 100)
    assert [len(t.runs[3][0]) for t in language_id.count_language_model(df, F.lit(True)).trees] == [50, 50]
    # Limits: of all texts that teach nothing, each once.
    rates = {r.text: (r.language.lang_pred, r.language.bits_per_byte) for r in language_id.identify_language(df.dropna(), model).collect()}
    limits = language_id.held_out_rates(df, model, F.lit(False))
    for lang, figures in limits.by_language.items():
        rate, n = np.array([(b, len(t.encode())) for t, (p, b) in rates.items() if p == lang]).T
        middle = np.median(rate)
        want = middle + 3 * max(np.quantile(rate, 0.99) - middle, 0.25), 3 * 1.4826 * np.median(np.abs(rate - middle) * np.sqrt(n))
        assert figures == pytest.approx(want, rel=0.03)
    assert set(limits.by_language) == {p for p, _ in rates.values()}


def test_language_accuracy(spark):
    from glyphlake.llm.queries import op5_language_id

    sf = "/root/testdata/sf0.01"
    rows = op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_base_queries_against_sql(spark):
    """Base spans and base counts against the registered SQL, on texts with every kind of span and repeat."""
    import duckdb

    from glyphlake.llm import oracles, queries
    from glyphlake.llm.quality_rules import quality_rules
    from glyphlake.llm.secrets import secret_scan

    texts = [t for _, t in corpus()] + ["é password: 'hunter22' TOKEN=abc secret = token: abcdefgh", f"AKIA{'Z9' * 9} AKIA12 {'0f' * 12}g{'0f' * 11} Api_Key:x.y-z/+=1", "a b c d e f\na b c d e f\n \n#|<>\n#|<>", "ü * ü * ü * ü * ü * ü * ü"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = df.toPandas()
    with duckdb.connect() as db:
        db.register("documents", documents)
        for made, sql in ((queries.base_spans(secret_scan(df)), oracles.SECRET_BASE), (queries.base_counts(quality_rules(df)), oracles.QUALITY_BASE)):
            want = db.sql(f"SELECT {', '.join(made.columns)} FROM ({sql}) ORDER BY doc_id").fetchall()
            assert [tuple(r) for r in made.orderBy("doc_id").collect()] == want


def naive_quality(rows, labels):
    """The model's parts from their definition: sets of byte n-grams, scaled by log-count ratios, rows of length one."""
    from glyphlake.llm.quality_classifier import FEATURES, WIDTH

    ids = []
    for text in rows:
        raw = text.encode()
        own = {raw[i] << 8 | raw[i + 1] for i in range(len(raw) - 1)}
        own |= {WIDTH + ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 >> 13 & WIDTH - 1) for i in range(len(raw) - 2)}
        ids.append(sorted(own))
    counts = [dict.fromkeys(range(FEATURES), 1.0), dict.fromkeys(range(FEATURES), 1.0)]
    for own, y in zip(ids, labels, strict=True):
        for f in own:
            counts[y][f] += 1
    sums = [sum(c.values()) for c in counts]
    ratio = {f: math.log(counts[1][f] / sums[1]) - math.log(counts[0][f] / sums[0]) for own in ids for f in own}
    return ids, ratio


def test_quality_model_against_brute_force():
    from glyphlake.llm import kernel
    from glyphlake.llm.quality_classifier import fit_nb_svm, indicators

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef " if i % 2 else "efghij ") for _ in range(rng.randrange(2, 80))) for i in range(40)]
    labels = [i % 2 for i in range(40)]
    ids, ratio = naive_quality(texts, labels)
    block = next(iter(kernel.blocks(pa.array(texts))))
    got = [[] for _ in texts]
    for doc, feature in indicators(block.buf, block.offs):
        for d, f in zip(doc.tolist(), feature.tolist(), strict=True):
            got[d].append(f)
    assert [sorted(g) for g in got] == ids
    model = fit_nb_svm([np.array(i, np.int32) for i in ids], np.array(labels), epochs=200)
    for f, r in ratio.items():
        assert model.weights[f, 1] == pytest.approx(r * r, rel=1e-4, abs=1e-9)
    # The dual optimum separates what can be separated: every row lies on its side, on or beyond the margin.
    margins = [sum(float(model.weights[f, 0]) for f in i) / max(math.sqrt(sum(ratio[f] ** 2 for f in i)), 1e-6) + model.bias for i in ids]
    assert all((m > 0) == (y == 1) for m, y in zip(margins, labels, strict=True))
    scores = model.scores(block)
    assert np.allclose(scores, [1 / (1 + math.exp(-(model.slope * m + model.shift))) for m in margins], atol=1e-4)


def test_quality_classifier(spark, docs):
    from glyphlake.llm.queries import op7_quality_classifier
    from glyphlake.llm.quality_classifier import score_quality, train_quality_model

    sf = "/root/testdata/sf0.1"
    rows = op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in score_quality(docs, train_quality_model(docs, none, F.lit(True))).collect()} == {0.5}


def test_neighbours(spark):
    from glyphlake.llm.ann import nearest_neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1001, None), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0, None] * 4), (1005, [1.0]), (None, [1.0] * 8), (40, x[40].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in {v for _, v, _ in near}
        for _, v, s in near:
            assert s == pytest.approx(float(y[v] @ y[q]), rel=1e-12, abs=1e-12)
        score = y @ y[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(score, 9)))[:20]
        hits += len(set(want.tolist()) & {v for _, v, _ in near})
    assert hits >= 0.9 * 20 * len(got)
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_over_many_lists(spark, monkeypatch):
    """Clustered vectors over many lists: boundary vectors are copied, few lists are read, queries and lists are cut."""
    from glyphlake.llm import ann

    monkeypatch.setattr(ann, "LIST_SIZE", 64)
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(24, 16))
    x = middle[rng.integers(24, size=3000)] + 0.4 * rng.normal(size=(3000, 16))
    copies, probed, made = [], [], []
    real = ann._Index.calibrate

    def calibrate(self, sample, *args, **more):
        real(self, sample, *args, **more)
        rows, _ = self.lists_of(x)
        read, _ = self.probes_of(x[::20])
        made.append(len(self.graph.c))
        copies.append(len(rows) / len(x))
        probed.append(len(read) / (len(x[::20]) * len(self.graph.c)))

    monkeypatch.setattr(ann._Index, "calibrate", calibrate)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.vec_id] @ x[r.query_id]), rel=1e-12, abs=1e-12)
    assert made[0] >= 16 and copies[0] > 1 and probed[0] < 0.5
    scores = x[::20] @ x.T
    scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    want = np.argsort(-scores, 1)[:, :20]
    assert sum(len(got[20 * i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * 20 * 150


def test_neighbours_hold_little_in_the_driver():
    """Calibration takes no memory for each pair of a sampled vector and a centroid."""
    import tracemalloc

    from glyphlake.llm import ann

    x = np.random.default_rng(3).normal(size=(8192, 8))
    whole = np.concatenate((x, np.zeros((len(x), 1))), 1)
    index = ann._Index(ann.CentroidGraph(whole[:2048]), 8, "<f8", float((x**2).sum(1).max()), 3, 1.02)
    tracemalloc.start()
    index.calibrate(x, 20, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.probe_ratio > 1 and peak < 2 * len(x) * 2048


def test_neighbours_send_a_query_once_a_block(spark, monkeypatch):
    """Rows dealt out and rows sent to the driver stay few: no query goes to each of its lists, no partition sends its share of the sample."""
    from glyphlake.llm import ann

    monkeypatch.setattr(ann, "LIST_SIZE", 32)
    monkeypatch.setattr(ann, "SAMPLE_PER_LIST", 16)
    x = np.random.default_rng(9).normal(size=(2000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    taken, written = [], []
    to_pandas, table = type(df).toPandas, ann.Scratch.table
    monkeypatch.setattr(type(df), "toPandas", lambda self: taken.append(out := to_pandas(self)) or out)
    monkeypatch.setattr(ann.Scratch, "table", lambda self, df: written.append(out := table(self, df)) or out)
    near = ann.nearest_neighbours(df).collect()
    assert len(taken) == 1 and 900 < len(taken[0]) < 1200
    assert written[-1].count() <= 100 * spark.sparkContext.defaultParallelism  # probes: blocks, not 62 lists
    got = {}
    for r in near:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::20] @ x.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    want = np.argsort(-scores, 1)[:, :20]
    assert sum(len(got[20 * i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * 20 * 100


def test_components(spark):
    from glyphlake.llm.components import connected_components
    from glyphlake.llm.scratch import Scratch

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    root = {i: i for e in edges for i in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: r for i, r in root.items() if i in linked}


def test_pipeline(spark):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "x", 4) for i, t in corpus()]
    rows.append((500, "my secret = hunter2hunter2 " + " ".join(f"q{i}" for i in range(30)), "en", "s", 0, 1, 2, 3, "x", 4))
    # Texts under one id: two that differ, one of them twice; and a row without an id.
    other = " ".join(f"z{i}" for i in range(25))
    rows += [(0, other, "en", "s", len(other), 1, 2, 3, "x", 4), (0, other, "en", "s", len(other), 1, 2, 3, "w", 4), (None, other, "en", "s", len(other), 1, 2, 3, "x", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Language int, secrets int, n_removed int, row string, tag int"
    docs = first = spark.createDataFrame(rows, schema)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert {(r.Language, r.secrets, r.n_removed, r.tag) for r in out.collect()} == {(1, 2, 3, 4)}
        docs = out
        sizes.append(out.count())
        if name == "ngram_jaccard_join":
            kept = [(r.doc_id, r.text, r.row) for r in out.collect()]
            sets = [shingles(t) for i, t, _ in kept if i is not None]
            assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a)
            assert [k for k in kept if k[1] == other] in ([(0, other, "w"), (None, other, "x")], [(None, other, "x"), (0, other, "w")])
            assert (0, dict(corpus())[0], "x") in kept
        if name == "substring_dedup":
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id != 500)
        if name == "secret_scan":
            assert "hunter2" not in " ".join(r.text for r in out.collect())
    assert sizes[:4] == sorted(sizes[:4], reverse=True) and sizes[4] >= sizes[3]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, first.limit(0), "")
        assert none.count() == 0 and (name == "best_fit_packing" or none.columns == first.columns)
