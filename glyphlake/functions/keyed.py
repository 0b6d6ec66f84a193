"""Keyed replay test of token sequences: contexts seed uniforms, and their exponential sum is tested.

Each context of ``window`` tokens counts once, at its first place.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")


def simple_tokens(text: str) -> list[bytes]:
    """The first 8 bytes of the SHA-256 of each ASCII word."""
    return [hashlib.sha256(t.encode()).digest()[:8] for t in _TOKEN.findall(text.translate({c: c + 32 for c in range(65, 91)}))]


def token_ids(raw: str) -> list[bytes]:
    """Token ids as 8 bytes each, from a JSON array of integers or from lines (decimal, or hex with 0x); ValueError for anything else."""
    text = raw.strip()
    if text.startswith("["):
        values = json.loads(text, parse_int=str, parse_float=str)
        if not all(isinstance(v, str) for v in values):
            raise ValueError("token-id JSON must be an array of integers")
    else:
        values = [line.strip() for line in text.split("\n") if line.strip()]
    out = []
    for i, value in enumerate(values):
        hexadecimal = value[:2].lower() == "0x" and not text.startswith("[")
        digits = value[2:] if hexadecimal else value
        if not re.fullmatch("[0-9A-Fa-f]+" if hexadecimal else "[0-9]+", digits) or (number := int(digits, 16 if hexadecimal else 10)) >> 64:
            raise ValueError(f"token id {i}: must be an unsigned 64-bit integer")
        out.append(number.to_bytes(8, "big"))
    return out


def key_bytes(key: str) -> bytes:
    """A key in hex (with or without 0x), else its UTF-8."""
    raw = key.strip()
    digits = raw[2:] if raw[:2].lower() == "0x" else raw
    try:
        return bytes.fromhex(digits) if digits and len(digits) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", digits) else raw.encode()
    except ValueError:
        return raw.encode()


def poisson_below(mean: float, n: int) -> float:
    """P(N < n) of a Poisson variable, summed in logarithms; 1 for a mean or count of 0."""
    if n <= 0 or mean <= 0:
        return 1.0
    terms = [k * math.log(mean) - math.lgamma(k + 1) for k in range(n)]
    top = max(terms)
    return min(1.0, max(0.0, math.exp(top - mean + math.log(math.fsum(math.exp(t - top) for t in terms)))))


def replay(tokens: list[bytes], key: bytes, window: int = 4) -> tuple[int, int, float]:
    """(counted, repeated, statistic)."""
    seen: set[bytes] = set()
    statistic = 0.0
    for i in range(window, len(tokens)):
        context = b"".join(tokens[i - window : i])
        if context in seen:
            continue
        seen.add(context)
        seed = hmac.digest(key, context, "sha256")
        u = math.ldexp(int.from_bytes(hmac.digest(seed, tokens[i], "sha256")[:8], "big") + 0.5, -64)
        statistic -= math.log1p(-u) if u < 1 else -math.inf
    return len(seen), max(0, len(tokens) - window) - len(seen), statistic


def replay_test(df: DataFrame, key: str, *, text_col: str = "text", out_col: str = "replay", window: int = 4, threshold: float = 1e-6, ids: bool = False) -> DataFrame:
    """df with a struct of counts, statistic, p_value, score (-log10 p, at most 300) and is_watermarked; a null text has no tokens.

    With ids the column holds lists of token ids (see token_ids) instead of text; one
    that is no such list has a null struct.
    """
    if window < 1 or not 0 < threshold < 1:
        raise ValueError("window must be 1 or more and threshold between 0 and 1")
    secret = key_bytes(key)

    @F.arrow_udf("struct<tokens: bigint, skipped_no_context: bigint, skipped_repeated: bigint, counted: bigint, statistic: double, p_value: double, score: double, is_watermarked: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                try:
                    tokens = token_ids(text or "") if ids else simple_tokens(text or "")
                except ValueError:
                    rows.append(None)
                    continue
                counted, repeated, statistic = replay(tokens, secret, window)
                p = poisson_below(statistic, counted) if counted else 1.0
                score = min(300.0, -math.log10(p)) if p > 0 else 300.0
                rows.append((len(tokens), min(window, len(tokens)), repeated, counted, round(statistic, 6), p, round(score, 6) if counted else 0.0, counted > 0 and p < threshold))
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.bool_()]
            names = ["tokens", "skipped_no_context", "skipped_repeated", "counted", "statistic", "p_value", "score", "is_watermarked"]
            yield pa.StructArray.from_arrays([pa.array([r and r[i] for r in rows], k) for i, k in enumerate(kinds)], names, mask=pa.array([r is None for r in rows]))

    return df.withColumn(out_col, run(F.col(text_col).cast("string")))
