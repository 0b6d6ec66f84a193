"""Invisible and look-alike code points: what they are, and when text needs them.

Inspection and cleaning decide on the code points of interest alone, each with
its neighbours: an expression finds their places in a text, and what stands
between them is never walked.  Texts without any, nearly all of a corpus, are
recognised by a linear-time regular expression on the Arrow column and never
become Python strings.
"""

from __future__ import annotations

import difflib
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code points that carry nothing visible.
STRIPPED = [
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E,
    0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0x206A, 0x206B, 0x206C, 0x206D, 0x206E, 0x206F, 0xFEFF, 0x3164, 0xFFA0, 0xFFF9, 0xFFFA, 0xFFFB,
]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
CYRILLIC = dict(zip((0x0410, 0x0412, 0x0415, 0x041A, 0x041C, 0x041D, 0x041E, 0x0420, 0x0421, 0x0422, 0x0425, 0x0430, 0x0435, 0x043E, 0x0440, 0x0441, 0x0443, 0x0445, 0x0456), "ABEKMHOPCTXaeopcyxi", strict=True))
BIDI = {0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}
BIDI_MARKS = {0x061C, 0x200E, 0x200F, *range(0x2066, 0x206A)}
ORTHOGRAPHIC = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
WIDTHLESS = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E}
MONGOLIAN_SELECTORS = {0x180B, 0x180C, 0x180D, 0x180F}
KHMER_VOWELS = {0x17B4, 0x17B5}
HANGUL_FILLERS = {0x115F, 0x1160, 0x3164, 0xFFA0}
# Blocks of scripts and emoji, layout controls, and kinds.
EMOJI_SINGLES = set(map(ord, "‼⁉ℹ⤴⤵©®™〰〽㊗㊙#*0123456789"))
CJK = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]
JAMO = [(0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0xD7B0, 0xD7C6), (0xFFA1, 0xFFDC)]
EMOJI = [(0x2190, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF)]
JOINING = [(0x0600, 0x08FF), (0x0900, 0x0DFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF)]
#: Format controls of laid-out scripts, with the half-open block that must stand beside them.
LAYOUT = [((0x13430, 0x1343F), (0x13000, 0x14400)), ((0x1BCA0, 0x1BCA3), (0x1BC00, 0x1BCA4)), ((0x1D173, 0x1D17A), (0x1D100, 0x1D200))]
#: Kinds by range, first match first; what no range holds is of kind "strip".
KINDS = [
    ("tag_chars", [(0xE0001, 0xE007F)]),
    ("noncharacter", [(0xFDD0, 0xFDEF), *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17))]),
    ("reserved_ignorable", [(0x2065, 0x2065), (0xE0000, 0xE0000), (0xFFF0, 0xFFF8), (0xE0080, 0xE00FF), (0xE01F0, 0xE0FFF)]),
    ("variation_selector", [(0xE0100, 0xE01EF), (0xFE00, 0xFE0F), *((c, c) for c in sorted(MONGOLIAN_SELECTORS))]),
    ("bidi", [(c, c) for c in sorted(BIDI)]),
    ("zwj_family", [(c, c) for c in sorted(WIDTHLESS)]),
    ("private_use", [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]),
]
FLAG, TAG_END = chr(0x1F3F4), 0xE007F


class Ranges:
    """Membership in closed ranges of code points."""

    def __init__(self, ranges):
        ranges = sorted(ranges)
        self.low, self.high = [a for a, _ in ranges], [b for _, b in ranges]

    def __contains__(self, c: int) -> bool:
        i = bisect_right(self.low, c) - 1
        return i >= 0 and c <= self.high[i]

    def index(self, c: int) -> int:
        i = bisect_right(self.low, c) - 1
        return i if i >= 0 and c <= self.high[i] else -1


_CJK, _JAMO, _EMOJI, _JOINING = Ranges(CJK), Ranges(JAMO), Ranges(EMOJI), Ranges(JOINING)
_KIND_RANGES = [(kind, Ranges(r)) for kind, r in KINDS]
#: Kinds that are removed as a whole; the others only by the list of single code points.
_ALWAYS = Ranges([*(r for kind, rs in KINDS if kind in ("tag_chars", "noncharacter", "reserved_ignorable", "private_use") for r in rs), (0xE0100, 0xE01EF), (0xFE00, 0xFE0F)])
_SINGLES, _SPACE_SET = set(STRIPPED), set(SPACES)
_CONFUSABLE = CYRILLIC | {0xFF21 + i: chr(0x41 + i) for i in range(26)} | {0xFF41 + i: chr(0x61 + i) for i in range(26)}


def _class(points) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in points)


#: Code points that a decision can be about; letters that look like others only where these are folded.
_POINTS = [*((c, c) for c in (*STRIPPED, *SPACES)), *(r for _, rs in KINDS for r in rs)]
_ALIKE = [*((c, c) for c in CYRILLIC), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]


def _worth(alike: bool) -> str:
    """A linear-time expression for Arrow that finds any of them."""
    return f"[{_class([*_POINTS, *(_ALIKE if alike else [])])}\\p{{Cf}}]"


@cache
def _places(alike: bool) -> regex.Pattern:
    """The same for Python strings."""
    spans = [*_POINTS, *(_ALIKE if alike else [])]
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans) + "\\p{Cf}]")


@dataclass(frozen=True)
class CleanOptions:
    normalize_spaces: bool = True
    confusables: bool = False
    strip_emoji_glue: bool = False
    strip_bidi: bool = False
    nfkc: bool = False


INSPECTION = CleanOptions(strip_bidi=True)


def strip_kind(c: int) -> str:
    return next((kind for kind, ranges in _KIND_RANGES if c in ranges), "strip")


#: Code points whose names are given: controls that carry nothing visible, spaces, selectors and layout controls.
_NAMED = Ranges([*((c, c) for c in (*STRIPPED, *SPACES, 0xE0001, 0xE0020, 0xE0041, 0xE007F)), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF), *(r for r, _ in LAYOUT)])


def label(c: int) -> str:
    """U+XXXX, the name (UNKNOWN for all but invisible characters and spaces), and the general category."""
    name = unicodedata.name(chr(c), "UNKNOWN") if c in _NAMED else "UNKNOWN"
    return f"U+{c:04X} {name} ({unicodedata.category(chr(c))})"


def _emoji(c: int | None) -> bool:
    return c is not None and (c in _EMOJI or c in EMOJI_SINGLES)


def _letter(c: int, low: int, high: int) -> bool:
    return low <= c <= high and unicodedata.category(chr(c))[0] == "L"


def _joins(c: int | None) -> int:
    return _JOINING.index(c) if c is not None and unicodedata.category(chr(c))[0] in "LM" else -1


def _flag_tags(text: str, places: list[int]) -> set[int]:
    """Positions of tags that spell a flag: after the black flag, one or more tags and the closing one."""
    out: set[int] = set()
    for start in places:
        if start and text[start - 1] == FLAG and 0xE0020 <= ord(text[start]) < TAG_END:
            end = start + 1
            while end < len(text) and 0xE0020 <= ord(text[end]) < TAG_END:
                end += 1
            if end < len(text) and ord(text[end]) == TAG_END:
                out.update(range(start, end + 1))
    return out


def _paired_embeddings(text: str, places: list[int]) -> set[int]:
    """Positions of left-to-right and right-to-left embeddings that are closed, and of their closers; overrides never count."""
    out: set[int] = set()
    open_: list[int] = []
    for i in places:
        c = ord(text[i])
        if c in (0x202A, 0x202B, 0x202D, 0x202E):
            open_.append(i)
        elif c == 0x202C and open_:
            start = open_.pop()
            if ord(text[start]) <= 0x202B:
                out |= {start, i}
    return out


def _needed(c: int, before: int | None, after: int | None, kept: int | None) -> bool:
    """Whether its surroundings give an invisible code point a use."""
    if before is not None and ((0xE0100 <= c <= 0xE01EF or 0xFE00 <= c <= 0xFE0D) and before in _CJK or c in MONGOLIAN_SELECTORS and 0x1800 <= before <= 0x18AF):
        return True
    if c in (0xFE0E, 0xFE0F):
        return _emoji(before)
    if c == 0x200D and _emoji(kept) and _emoji(after):
        return True
    if c in (0x200C, 0x200D):
        return _joins(before) >= 0 and _joins(before) == _joins(after)
    if kept is not None and (c in MONGOLIAN_SELECTORS and _letter(kept, 0x1800, 0x18AF) or c in KHMER_VOWELS and _letter(kept, 0x1780, 0x17FF) or c in HANGUL_FILLERS and kept in _JAMO):
        return True
    return c in ORTHOGRAPHIC or any(a <= c <= b and any(n is not None and x <= n < y for n in (before, after)) for (a, b), (x, y) in LAYOUT)


def _glue(c: int) -> bool:
    return c in (0x200C, 0x200D) or 0xE0100 <= c <= 0xE01EF or 0xFE00 <= c <= 0xFE0F or 0xE0020 <= c <= 0xE007F or c in MONGOLIAN_SELECTORS or c in KHMER_VOWELS or c in HANGUL_FILLERS


def decisions(text: str, options: CleanOptions) -> Iterator[tuple[int, int, str | None, str]]:
    """(position, code point, replacement or None to remove, kind) of every code point that isn't kept.

    What is kept last before a place is the character before it, unless that is
    of interest too; then what was decided there carries over.
    """
    places = [m.start() for m in _places(options.confusables).finditer(text)]
    flags, pairs = _flag_tags(text, places), _paired_embeddings(text, places)
    kept: int | None = None
    past = -1  # the last place of interest
    for i in places:
        c = ord(text[i])
        before, after = ord(text[i - 1]) if i else None, ord(text[i + 1]) if i + 1 < len(text) else None
        if i - 1 > past:
            kept = before
        past = i
        stays = not options.strip_bidi and (i in pairs or c in BIDI_MARKS)
        stays = stays or not options.strip_emoji_glue and (i in flags or _needed(c, before, after, kept))
        if not stays:
            if c in _SINGLES or c in _ALWAYS:
                yield i, c, None, strip_kind(c)
                continue
            swap = (" ", "space") if options.normalize_spaces and c in _SPACE_SET else (_CONFUSABLE[c], "confusable") if options.confusables and c in _CONFUSABLE else None
            if swap:
                yield i, c, *swap
                kept = ord(swap[0])
                continue
            if unicodedata.category(text[i]) == "Cf":
                yield i, c, None, "other_cf"
                continue
        if not _glue(c):
            kept = c


def changed_by_nfkc(before: str, after: str) -> int:
    """Source characters outside the blocks that a longest-match alignment keeps; beyond 4 million cells, outside the common ends."""
    if before == after:
        return 0
    if len(before) * len(after) > 4_000_000:
        n = min(len(before), len(after))
        head = next((i for i in range(n) if before[i] != after[i]), n)
        tail = next((i for i in range(n - head) if before[-1 - i] != after[-1 - i]), n - head)
        return len(before) - head - tail
    blocks = difflib.SequenceMatcher(None, before, after, autojunk=False).get_matching_blocks()
    return len(before) - sum(b.size for b in blocks)


def clean(text: str, options: CleanOptions, by_label: tuple[dict[str, int], dict[str, int]] | None = None) -> tuple[str, int, int]:
    """(clean text, removed, replaced); by_label gets the counts of what was removed and replaced by label."""
    out, at, removed, replaced = [], 0, 0, 0
    for i, c, new, _ in decisions(text, options):
        out += [text[at:i], new or ""]
        at = i + 1
        removed, replaced = removed + (new is None), replaced + (new is not None)
        if by_label is not None:
            tally, name = by_label[new is not None], label(c)
            tally[name] = tally.get(name, 0) + 1
    result = "".join([*out, text[at:]])
    if options.nfkc:
        folded = unicodedata.normalize("NFKC", result)
        replaced += changed_by_nfkc(result, folded)
        result = folded
    return result, removed, replaced


_HITS = "struct<suspicious_total: bigint, hits: array<struct<codepoint: int, label: string, kind: string, confidence: string, count: bigint, sample_offsets: array<int>>>>"
_HIT_LIST = pa.list_(pa.struct([("codepoint", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.string()), ("count", pa.int64()), ("sample_offsets", pa.list_(pa.int32()))]))


def _hits(text: str) -> tuple[int, list[dict]]:
    found: dict[tuple[int, str], list[int]] = {}
    for at, c, _, what in decisions(text, INSPECTION):
        found.setdefault((c, what), []).append(at)
    ordered = sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))
    hits = [{"codepoint": c, "label": label(c), "kind": what, "confidence": "informational" if what == "space" else "probable", "count": len(at), "sample_offsets": at[:10]} for (c, what), at in ordered]
    return sum(map(len, found.values())), hits


def _worth_rows(column: pa.Array, pattern: str) -> np.ndarray:
    """Rows that the pattern finds something in; bytes that are no UTF-8 text are rows too."""
    if not pa.types.is_binary(column.type):
        return np.flatnonzero(pc.match_substring_regex(column.fill_null(""), pattern).to_numpy(zero_copy_only=False))
    try:
        return _worth_rows(column.cast(pa.string()), pattern)
    except pa.ArrowInvalid:  # some are: all that hold more than ASCII are looked at
        plain = pc.match_substring_regex(column.fill_null(b""), "^[\\x00-\\x7F]*$")
        return np.flatnonzero(~plain.to_numpy(zero_copy_only=False))


def _text(value: str | bytes) -> str:
    """A text, or bytes as text: an invalid byte becomes U+DC00 plus the byte."""
    return value if isinstance(value, str) else value.decode("utf-8", "surrogateescape")


def inspect_text(df: DataFrame, text_col: str = "text", out_col: str = "inspection") -> DataFrame:
    """df with suspicious code points by (code point, kind): count and first ten offsets, most frequent first.

    The column holds text or bytes; an invalid byte is a unit of its own that is
    never suspicious.  Inspection is stricter than cleaning: bidi controls always
    count.  A null text has none.
    """
    binary = dict(df.dtypes)[text_col] == "binary"

    @F.arrow_udf(_HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n = len(texts)
            totals, hits = [0] * n, [[]] * n
            for i in _worth_rows(texts, _worth(INSPECTION.confusables)).tolist():
                totals[i], hits[i] = _hits(_text(texts[i].as_py()))
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(hits, _HIT_LIST)], ["suspicious_total", "hits"])

    # Not deterministic for the optimizer: a filter on the outcome must not run it a second time.
    return df.withColumn(out_col, run.asNondeterministic()(F.col(text_col) if binary else F.col(text_col).cast("string")))


def clean_text(df: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text", out_col: str = "cleaning") -> DataFrame:  # noqa: B008
    """df with a struct of the cleaned text, the numbers of removed and replaced code points, these by label, and the lengths before and after (null for a null text).

    The column holds text or bytes, and so does ``cleaned``; invalid bytes stay.
    What NFKC changes is counted as replaced, but has no label.
    """
    binary = dict(df.dtypes)[text_col] == "binary"
    kind = pa.binary() if binary else pa.string()

    labels = pa.map_(pa.string(), pa.int64())

    @F.arrow_udf(f"struct<cleaned: {'binary' if binary else 'string'}, removed: bigint, replaced: bigint, removed_labels: map<string, bigint>, replaced_labels: map<string, bigint>, length: bigint, cleaned_length: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            removed, replaced = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            worth = _worth_rows(texts, "[^\\x00-\\x7F]" if options.nfkc else _worth(options.confusables))
            out = texts
            tallies: list[list[list]] = [[[]] * len(texts), [[]] * len(texts)]
            units = (pc.binary_length if binary else pc.utf8_length)(texts.fill_null(b"" if binary else "")).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = [units, units.copy()]
            if binary and len(wide := _worth_rows(texts, "[^\\x00-\\x7F]")):
                units[wide] = [len(_text(texts[i].as_py())) for i in wide.tolist()]
                lengths[1] = units.copy()
            if len(worth):
                values = texts.to_pylist()
                for i in worth.tolist():
                    by_label: tuple[dict[str, int], dict[str, int]] = ({}, {})
                    cleaned, removed[i], replaced[i] = clean(_text(values[i]), options, by_label)
                    lengths[1][i] = len(cleaned)
                    for column, tally in zip(tallies, by_label, strict=True):
                        column[i] = sorted(tally.items())
                    values[i] = cleaned.encode("utf-8", "surrogateescape") if binary else cleaned
                out = pa.array(values, kind)
            columns = [out.cast(kind), pa.array(removed), pa.array(replaced), *(pa.array(t, labels) for t in tallies), *map(pa.array, lengths)]
            yield pa.StructArray.from_arrays(columns, ["cleaned", "removed", "replaced", "removed_labels", "replaced_labels", "length", "cleaned_length"], mask=texts.is_null())

    return df.withColumn(out_col, run.asNondeterministic()(F.col(text_col) if binary else F.col(text_col).cast("string")))
