"""Quality rules: counts of a text, and its repetition from a suffix array.

All texts of a block form one word sequence, in which suffixes sort by document
first; prefix doubling sorts only suffixes that still tie, so its rounds grow
with the logarithm of the longest repeat inside a document.  The kept ranks of
each round give the longest common prefix of neighbours.  A suffix whose longer
neighbouring common prefix has l words starts a repeated stretch of l words:
together these are the spans of all maximal repeats (the intervals of the
longest-common-prefix array).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1  # fixed value: the symbols that count
_GAPS = " \t\n\v\f\r"
#: Limits of the method, taken from labelled texts: of 3,330 good ones that pass the base rules, none has more than 0.204 of its characters under repeats, none a repeat of more than 13 words.
MAX_COVERED, MAX_REPEAT_WORDS = 0.25, 20


def repeat_lengths(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each word position, the most words from there on that also occur elsewhere in its document."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    last = offs[1:][doc]  # end of each position's document
    # Ranks are places: a tied group has the place of its first, so that sorting inside it moves no other.
    order = np.argsort(words)
    word = np.empty(n, np.int64)
    word[order] = np.cumsum(np.concatenate(([0], words[order][1:] != words[order][:-1])))
    rank, tied = _places(doc * n + word)
    ranks, span = [rank], 1
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)  # right for all that have a place of their own
    while len(tied):
        at = tied + span
        ahead = np.where(at < last[tied], rank[np.minimum(at, n - 1)] + 1, 0)  # 0: past the document's end
        within, still = _places(rank[tied] * (n + 1) + ahead)
        # Tied suffixes fill the places of their groups in order; a group's first place is its rank.
        group = rank[tied]
        by = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[by], group)
        rank = rank.copy()
        rank[tied] = group + within - begin
        suffix[rank[tied]] = tied
        tied = tied[still]
        ranks.append(rank)
        span *= 2
    # Longest common prefix of neighbours that share a first word: halves from the longest down.
    low = np.flatnonzero(ranks[0][suffix[:-1]] == ranks[0][suffix[1:]])
    left, right = suffix[low], suffix[low + 1]
    end_l, end_r = last[left], last[right]
    common = np.zeros(len(low), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        i, j = left + common, right + common
        ok = np.flatnonzero((i < end_l) & (j < end_r))
        common[ok] += (r[i[ok]] == r[j[ok]]) << level
    out = np.zeros(n, np.int64)
    out[right] = common
    out[left] = np.maximum(out[left], common)
    return out


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place in sorted order (equal keys share their first's), and the indices of keys that are not alone."""
    order = np.argsort(keys)
    ranked = keys[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    place = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = place
    return out, order[~(head & np.concatenate((head[1:], [True])))]


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Words under the union of the spans [i, i + lengths[i]) of at least ``least`` words."""
    reach = np.where(lengths >= least, np.arange(len(lengths)) + lengths, 0)
    return np.maximum.accumulate(reach) > np.arange(len(lengths)) if len(reach) else np.zeros(0, bool)


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_GAPS)]
    return len(lines) - len(set(lines))


def quality_rules(
    df: DataFrame, *, text_col: str = "text", window: int = 5, min_words: int = 10, max_repeat_percent: int = 20, max_covered: float = MAX_COVERED, max_repeat_words: int = MAX_REPEAT_WORDS
) -> DataFrame:
    """df with a struct column ``rules``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (words in windows of ``window`` words found twice or more), base_failed, then
    the method's covered_fraction (of the words' characters, under the union of
    maximal repeats of ``window`` words or more), longest_repeat (words), and
    kept: not base_failed, covered_fraction <= max_covered and longest_repeat <=
    max_repeat_words.  A null text is an empty one and fails.  Whole texts are
    judged.  Narrow; rows, repeated ones too, and other columns are kept, a
    column named ``rules`` is replaced; an empty table stays empty.
    """
    kind = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, covered_fraction: double, longest_repeat: bigint, kept: boolean>"

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(9)]
            for b in kernel.blocks(texts):
                whole = np.concatenate(([0], np.cumsum((b.buf & 0xC0) != 0x80)))
                sizes = whole[b.end] - whole[b.start]  # code points of each word
                chars = kernel.fold(sizes, b.word_offs)
                lengths = repeat_lengths(kernel.word_hashes(b), b.word_offs)
                under = covered(lengths, window)
                repeated = kernel.fold(under.astype(np.int64), b.word_offs)
                part = kernel.fold(sizes * under, b.word_offs) / np.maximum(chars, 1)
                longest = np.zeros(b.n, np.int64)
                full = np.flatnonzero(b.n_words)
                if len(full):
                    longest[full] = np.maximum.reduceat(lengths, b.word_offs[full])
                lines = np.array([_duplicate_lines(b.text(x, y)) for x, y in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True)], np.int64)
                failed = (b.n_words < min_words) | (100 * repeated > max_repeat_percent * b.n_words)
                kept = ~failed & (part <= max_covered) & (longest <= max_repeat_words)
                symbols = kernel.fold(_SYMBOL[b.buf], b.offs)
                for column, value in zip(columns, (b.n_words, chars, symbols, lines, repeated, failed, part, longest, kept), strict=True):
                    column.append(value)
            names = [f.split(":")[0].strip() for f in kind[7:-1].split(",")]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in columns], names)

    return df.withColumn("rules", judge(F.col(text_col).cast("string")))
