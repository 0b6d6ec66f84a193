"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary holds what people write, so words, names and paths take
few tokens and random strings many.  A candidate string whose characters per
token fall under a limit is reported.  Exact digest and UUID shapes look random
but are public: they are cut out of a candidate, and what is left is tested.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Tells, in linear time, which texts can hold any span at all.
_WORTH = r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}"
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Shortest candidate, the length from which the full limit holds, and the stricter limit's share of it below: for letters of one case, and for others.
_LEAST, _FULL, _ONE_CASE, _STRICTER = 16, 20, 0.8, 0.9
KINDS = ("assign", "access", "hex", "random")

#: Public shapes that look random: UUIDs, digests in hex of usual lengths (MD5 to SHA-512, short commit ids do not reach 16), subresource digests, numbers with separators (dates, telephone and item numbers), and the alphabet.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==|[0-9]+(?:[-/_=+]+[0-9]+)+)(?![A-Za-z0-9])"
    r"|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
#: What is between separators.
_PIECE = re.compile(r"[^/=_-]+")
#: Parts of an identifier: words, constants, numbers, or camel case.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def tiktoken_encoding(vocabulary: str):
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("glyphlake", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def without(start: int, end: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of start to end without the cuts."""
    for a, b in sorted(cuts):
        if start < a:
            yield start, min(a, end)
        start = max(start, b)
    if start < end:
        yield start, end


class TokenEfficiency:
    """Candidates of 20 characters or more under ``chars_per_token`` characters a token; of 16 to 19 under nine tenths of it, or eight if they are letters of one case.

    A candidate is tested whole, then without the words at its ends, then piece
    by piece between its separators, so that a path glued on hides nothing.
    """

    def __init__(self, vocabulary: str, chars_per_token: float):
        self.encoding = tiktoken_encoding(vocabulary)
        self.limit = chars_per_token

    def tokens(self, s: str) -> int:
        return len(self.encoding.encode_ordinary(s))

    def wordy(self, s: str) -> bool:
        """Whether words of few tokens each make up four fifths of it."""
        parts = _PART.findall(s)
        words = sum(len(p) for p in parts if len(p) >= 3 and p.isalpha() and 3 * self.tokens(p) <= len(p))
        return 5 * words >= 4 * sum(map(len, parts))

    def random(self, s: str) -> bool:
        n = len(s)
        if n < _LEAST:
            return False
        share = 1 if n >= _FULL else _ONE_CASE if s.isalpha() and (s.islower() or s.isupper()) else _STRICTER
        return n < self.limit * share * self.tokens(s) and not self.wordy(s)

    def found(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        if self.random(text[a:b]):
            return [(a, b)]
        pieces = [m.span() for m in _PIECE.finditer(text, a, b)]
        if len(pieces) < 2:
            return [x for x in pieces if x != (a, b) and self.random(text[slice(*x)])]
        rest = list(pieces)
        while rest and self.wordy(text[slice(*rest[0])]):
            rest.pop(0)
        while rest and self.wordy(text[slice(*rest[-1])]):
            rest.pop()
        if rest and self.random(text[rest[0][0] : rest[-1][1]]):
            return [(rest[0][0], rest[-1][1])]
        return [(x, y) for x, y in rest if self.random(text[x:y])]

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random spans of the candidates: of a candidate whole, whatever base spans it holds, else of what these leave; none that a base span holds."""
        out: list[tuple[int, int]] = []
        reported = [(x, y) for x, _, y in base]
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            known = [(a + k.start(), a + k.end()) for k in _KNOWN.finditer(m[0])]
            for x, y in without(a, b, known):
                inside = [(i, j) for i, j in reported if i < y and x < j]
                got = self.found(text, x, y)
                out += got
                if inside:
                    for i, j in without(x, y, inside + got):
                        out += self.found(text, i, j)
        return [(a, 3, b) for a, b in out if not any(x <= a and b <= y for x, y in reported)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every stretch of overlapping spans replaced by mark; of an assignment only the value goes."""
    cut: list[list[int]] = []
    for a, k, b in sorted((a if k else ASSIGN.match(text, a).start(2), k, b) for a, k, b in spans):
        if cut and a < cut[-1][1]:
            cut[-1][1] = max(cut[-1][1], b)
        else:
            cut.append([a, b])
    out, at = [], 0
    for a, b in cut:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def secret_scan(df: DataFrame, *, text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", chars_per_token: float = 2.0, mark: str = "[REDACTED]", out_col: str = "secrets") -> DataFrame:
    """df with a struct column ``out_col``: n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted.

    Offsets are code points of the whole text, end exclusive.  base_sha256 is the
    digest of the base spans alone (of the empty string if there are none), spans
    holds all spans, redacted is the text with the secrets replaced (null if
    nothing was found: the text itself then stands).  Of overlapping spans the
    whole stretch is replaced once.  A null text is an empty one.  Very long
    texts are scanned whole.  Narrow; rows, repeated ones too, and other columns
    are kept, a column named ``out_col`` is replaced; an empty table stays empty.
    """
    worth = pa.scalar(_WORTH)

    @F.arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, n_random: bigint, base_sha256: string, spans: string, redacted: string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = TokenEfficiency(vocabulary, chars_per_token)
        nothing = hashlib.sha256(b"").hexdigest()
        for texts in batches:
            n = len(texts)
            counts = np.zeros((4, n), np.int64)
            digest, joined, clean = [nothing] * n, [""] * n, [None] * n
            hits = pc.match_substring_regex(texts.fill_null(""), worth.as_py()).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hits).tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                spans = sorted(base + test.spans(text, base))
                for _, k, _ in spans:
                    counts[k, i] += 1
                if base:
                    digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                if spans:
                    joined[i], clean[i] = _joined(spans), redact(text, spans, mark)
            yield pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(digest), pa.array(joined), pa.array(clean, pa.string())], ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"])

    return df.withColumn(out_col, scan(F.col(text_col).cast("string")))
