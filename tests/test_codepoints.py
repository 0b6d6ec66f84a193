import itertools
import random
import unicodedata

import pytest

from glyphlake.functions import codepoints
from glyphlake.functions.codepoints import INSPECTION, CleanOptions, changed_by_nfkc, clean, clean_text, decisions, inspect_text


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("A​B C‮D", CleanOptions(), ("AB CD", 2, 1)),
        ("ＡＢ ﬃ", CleanOptions(nfkc=True), ("AB ffi", 0, 3)),
        ("Å Å", CleanOptions(nfkc=True), ("Å Å", 0, 4)),
        ("\U0001f468‍\U0001f469a‍b", CleanOptions(), ("\U0001f468‍\U0001f469ab", 1, 0)),
        ("\U0001f3f4\U000e0067\U000e0062\U000e007f\U000e0041", CleanOptions(), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", 1, 0)),
        ("‪ab‬‮ab‬", CleanOptions(), ("‪ab‬ab", 2, 0)),
        ("аb", CleanOptions(confusables=True), ("ab", 0, 1)),
        ("1️ ️", CleanOptions(), ("1️ ", 1, 0)),
        ("﻿x", CleanOptions(), ("x", 1, 0)),
        ("ب‌ب", CleanOptions(), ("ب‌ب", 0, 0)),
        ("", CleanOptions(), ("", 0, 0)),
    ],
)
def test_clean(text, options, want):
    assert clean(text, options) == want


def test_inspection_is_stricter():
    assert len(list(decisions("A​B C‮D", INSPECTION))) == 3
    assert len(list(decisions("‪ab‬", INSPECTION))) == 2


def test_alignment_count():
    assert changed_by_nfkc("aba", "bca") == 2


def test_cleaning_is_idempotent():
    rng = random.Random(5)
    alphabet = ["a", " ", "​", "‍", " ", "‪", "‬", "‮", "\U0001f468", "а", "\U000e0067", "ㅤ", "一", "️"]
    for _ in range(500):
        once = clean("".join(rng.choice(alphabet) for _ in range(rng.randrange(20))), CleanOptions(strip_bidi=True, strip_emoji_glue=True))[0]
        assert clean(once, CleanOptions(strip_bidi=True, strip_emoji_glue=True)) == (once, 0, 0)


def test_columns(spark):
    df = spark.createDataFrame([(1, "a​b​", "x"), (2, None, None), (3, "", "y"), (4, "plain", "z")], "id int, text string, cleaning string")
    rows = {r.id: r for r in inspect_text(df).collect()}
    assert rows[1].inspection.suspicious_total == 2 and rows[1].inspection.hits[0].sample_offsets == [1, 3]
    assert rows[2].inspection.suspicious_total == 0
    rows = {r.id: r for r in clean_text(df).collect()}
    assert rows[1].cleaning.removed_labels == {"U+200B ZERO WIDTH SPACE (Cf)": 2} and (rows[1].cleaning.length, rows[1].cleaning.cleaned_length, rows[4].cleaning.length) == (4, 2, 5)
    assert rows[1].cleaning.cleaned == "ab" and rows[2].cleaning is None and rows[4].cleaning.cleaned == "plain"


def walked(text, options):
    """decisions() as one walk over every code point."""
    kept, out = None, []
    places = range(len(text))
    flags, pairs = codepoints._flag_tags(text, list(places)), codepoints._paired_embeddings(text, list(places))
    for i, ch in enumerate(text):
        c, before, after = ord(ch), ord(text[i - 1]) if i else None, ord(text[i + 1]) if i + 1 < len(text) else None
        stays = not options.strip_bidi and (i in pairs or c in codepoints.BIDI_MARKS)
        stays = stays or not options.strip_emoji_glue and (i in flags or codepoints._needed(c, before, after, kept))
        if not stays and (c in codepoints._SINGLES or c in codepoints._ALWAYS):
            out.append((i, None))
        elif not stays and options.normalize_spaces and c in codepoints._SPACE_SET:
            out.append((i, " "))
            kept = 32
        elif not stays and options.confusables and c in codepoints._CONFUSABLE:
            out.append((i, codepoints._CONFUSABLE[c]))
            kept = ord(codepoints._CONFUSABLE[c])
        elif not stays and unicodedata.category(ch) == "Cf":
            out.append((i, None))
        elif not codepoints._glue(c):
            kept = c
    return out


def test_places_of_interest_are_all_places():
    rng = random.Random(1)
    points = [0x61, 0x20, 0x200B, 0x200D, 0x200C, 0xA0, 0x202A, 0x202B, 0x202C, 0x202E, 0x2066, 0x1F468, 0x1F3F4, 0x430, 0xE0067, 0xE007F, 0xE0041, 0x3164, 0x4E00, 0xFE0F, 0x1780, 0x17B4, 0x180B, 0x1820, 0x115F, 0xAC00, 0x628, 0x915, 0x31, 0x23, 0x600, 0xFFFE, 0x13430, 0x13001, 0xE000, 0xE0100, 0xFF21, 0x34F, 0xDCFF, 0x3FFFF]
    for options in (CleanOptions(*flags) for flags in itertools.product([False, True], repeat=4)):
        for _ in range(300):
            text = "".join(chr(rng.choice(points)) for _ in range(rng.randrange(14)))
            assert [(i, new) for i, _, new, _ in decisions(text, options)] == walked(text, options)


def test_bytes(spark):
    rows = [(1, b"a\xffb"), (2, bytes.fromhex("E19E80FFE19EB4")), (3, b"a\xe2\x80\x8bb"), (4, None), (5, b"\xf0\x9f"), (6, b"")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, text binary")
    got = {r.id: r.cleaning for r in clean_text(df).collect()}
    assert {i: bytes(c.cleaned) if c else None for i, c in got.items()} == {1: b"a\xffb", 2: bytes.fromhex("E19E80FF"), 3: b"ab", 4: None, 5: b"\xf0\x9f", 6: b""}
    assert got[3].removed_labels == {"U+200B ZERO WIDTH SPACE (Cf)": 1} and got[3].replaced_labels == {} and (got[3].length, got[3].cleaned_length) == (3, 2) and (got[1].length, got[2].cleaned_length) == (3, 2)
    found = {r.id: r.inspection for r in inspect_text(df).collect()}
    assert [found[i].suspicious_total for i in range(1, 7)] == [0, 1, 1, 0, 0, 0] and found[3].hits[0].label == "U+200B ZERO WIDTH SPACE (Cf)"
