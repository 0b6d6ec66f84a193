"""Style measures: formulaic phrases, sentence rhythm, lexical diversity, and their composite.

Words and sentences are counted on arrays of code points, many texts at a time.
Texts in which that could differ from the definition (fenced code, white space
other than space, tab, line feed, form feed and carriage return, letters whose
lower case is longer or depends on the letters beside) are measured one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

# Phrase patterns (RE2 syntax, case-insensitive), labels and weights.
MARKERS: list[tuple[str, str, float]] = [
    (r"\bdelve(?:s|d)?\s+into\b", "delve into", 1.2),
    (r"\ba\s+testament\s+to\b", "a testament to", 1.1),
    (r"\brich\s+tapestry(?:\s+of)?\b", "rich tapestry", 1.3),
    (r"\bplays?\s+a\s+(?:pivotal|crucial|vital|key)\s+role\b", "plays a pivotal/crucial role", 1.0),
    (r"\bin\s+(?:today'?s|the)\s+(?:(?:fast-paced|ever-evolving|digital|rapidly\s+changing)\s+)*(?:world|landscape|era|environment)\b", "in today's fast-paced world/landscape", 1.4),
    (r"\bit\s+is\s+(?:important|essential|crucial|worth\s+noting)\s+to\s+(?:note|remember|consider|highlight)\b", "it is important/crucial to note", 0.9),
    (r"\bnot\s+only\b[\w\s,]+\bbut\s+(?:also\s+)?(?:serves\s+to|acts\s+as|highlights)\b", "not only ... but also serves to", 0.8),
    (r"\bserve(?:s|d)?\s+as\s+a\s+(?:beacon|reminder|catalyst|cornerstone)\b", "serves as a beacon/catalyst/cornerstone", 1.1),
    (r"\bunderscore(?:s|d)?\s+the\s+(?:importance|need|significance)\b", "underscores the importance/need", 0.9),
    (r"\bfoster(?:s|ing|ed)?\s+a\s+(?:sense|culture|deeper\s+understanding)\b", "fosters a sense/culture", 0.9),
    (r"\bseamlessly\s+(?:integrates?|integrated|blends?|combine[sd]?)\b", "seamlessly integrates/blends", 1.0),
    (r"\bnavigat(?:e|ing|es|ed)\s+the\s+(?:complexities|intricacies|nuances)\b", "navigating the complexities/nuances", 1.0),
    (r"\bmultifaceted\s+(?:nature|approach|landscape)\b", "multifaceted nature/approach", 1.0),
    (r"\bharness(?:ing|ed|es)?\s+the\s+power\s+of\b", "harnessing the power of", 1.0),
    (r"\ba\s+myriad\s+of\b", "a myriad of", 0.8),
    (r"\bparadigm\s+shift\b", "paradigm shift", 0.9),
    (r"\bholistic\s+(?:approach|view|perspective)\b", "holistic approach/perspective", 0.9),
    (r"\bin\s+conclusion\b[,\s]", "in conclusion", 0.8),
    (r"\bto\s+summarize\b[,\s]", "to summarize", 0.8),
    (r"\bultimately\b[,\s]", "ultimately,", 0.6),
    (r"\bfurthermore\b[,\s]", "furthermore,", 0.6),
    (r"\bmoreover\b[,\s]", "moreover,", 0.6),
    (r"\bas\s+an\s+ai\b", "as an AI", 1.5),
    (r"\bi\s+hope\s+this\s+helps\b", "I hope this helps", 1.2),
    (r"\bstands?\s+as\s+a\s+testament\b", "stands as a testament to", 1.1),
    (r"\bmark(?:s|ing)?\s+an?\s+(?:indelible|pivotal|significant|new)\s+(?:moment|chapter|milestone)\b", "marking a pivotal moment/chapter", 1.0),
    (r"\b(?:reflecting|symbolizing|showcasing|underscoring)\s+(?:the|a|its)\b", "shallow -ing analysis (reflecting/symbolizing/showcasing)", 0.9),
    (r"\b(?:nestled|vibrant|breathtaking)\b", "sales language (nestled/vibrant)", 0.8),
    (r"\b(?:game[- ]changer|game-changing)\b", "game-changer", 0.9),
    (r"\b(?:unparalleled|unprecedented)\b", "unparalleled/unprecedented", 0.7),
    (r"\b(?:world-class|state-of-the-art|cutting-edge)\b", "world-class/state-of-the-art", 0.8),
    (r"\b(?:revolutionary|groundbreaking)\b", "revolutionary/groundbreaking", 0.6),
    (r"\b(?:leverag(?:e|ing|ed|es)|utiliz(?:e|ing|ed|es))\b", "leverage/utilize", 0.8),
    (r"\bboasts?\b", "boasts (copula avoidance)", 0.6),
    (r"\bit['’]?s\s+not\s+just\b", "it's not just X, it's Y", 0.8),
    (r"\b(?:not\s+just\b.{0,60}\bbut\s+also\b)", "not just X but also Y", 0.8),
    (r"\bdive(?:s|d)?\s+into\b", "dive into", 0.7),
    (r"\blet['’]?s\s+(?:dive\s+in|get\s+started)\b", "let's dive in", 0.7),
    (r"\bin\s+order\s+to\b", "in order to", 0.6),
    (r"\bdue\s+to\s+the\s+fact\s+that\b", "due to the fact that", 0.8),
    (r"\bit(?:['’]s| is)\s+worth\s+noting\s+that\b", "it is worth noting that", 0.8),
    (r"\b(?:needless\s+to\s+say|it\s+goes\s+without\s+saying)\b", "needless to say", 0.8),
    (r"\bthe\s+future\s+looks\s+bright\b", "the future looks bright", 0.9),
    (r"\b(?:sure\s+thing!?|great\s+question!?|happy\s+to\s+help)\b", "assistant chatter (sure thing/great question)", 0.6),
]
# Words that a score needs at least, and for full weight, and words of a window.
MIN_WORDS, FULL_WORDS, WINDOW = 30, 100, 50

#: A word: letters, numbers and underscores, with apostrophes and hyphens inside.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
_WORD = regex.compile(WORD)
_ANY_MARKER = "(?i)" + "|".join(f"(?:{p})" for p, _, _ in MARKERS)
_MARKERS = [re.compile(p, re.I | re.A) for p, _, _ in MARKERS]
_APART = re.compile("```|[^\\S \t\n\f\r]|\u03a3")
_SENTENCE_END = re.compile(r"[.!?]+[ \t\n\f\r]+|\n+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def sentences(text: str) -> list[str]:
    """Sentences outside fenced code; a line break ends one."""
    kept, fenced = [], False
    for line in map(str.strip, text.split("\n")):
        if line.startswith("```"):
            fenced = not fenced
        elif line and not fenced:
            kept.append(line)
    return [s for s in map(str.strip, _SENTENCE_END.split("\n".join(kept))) if s]


def moving_diversity(tokens: list[str], window: int = WINDOW) -> float:
    """Mean share of distinct words in windows; of the whole if it is no longer than one.

    A position adds to the windows in which it is its word's first: those that
    start after the word's previous place.
    """
    n = len(tokens)
    if n <= window:
        return len(set(tokens)) / n if n else 0.0
    last: dict[str, int] = {}
    total = 0
    for i, word in enumerate(tokens):
        first = max(i - window + 1, last.get(word, -1) + 1, 0)
        total += max(0, min(i, n - window) - first + 1)
        last[word] = i
    return total / window / (n - window + 1)


def burstiness(text: str) -> float | None:
    """Sample deviation over mean of words per sentence, for two sentences with words or more."""
    sizes = np.array([n for n in (len(_WORD.findall(s)) for s in sentences(text)) if n], float)
    return float(sizes.std(ddof=1) / sizes.mean()) if len(sizes) > 1 else None


def measures(text: str) -> tuple[int, int, float, float | None]:
    """(words, sentences, moving diversity, burstiness) of one text, from their definitions."""
    tokens = words(text)
    return len(tokens), len(sentences(text)), moving_diversity(tokens), burstiness(text)


_LETTER, _JOINT, _SPACE, _STOP = 1, 2, 4, 8


@cache
def _classes() -> np.ndarray:
    """Of each code point: part of a word, joint inside words, white space, end of a sentence."""
    category = arrays.categories()
    out = np.isin(category, np.frombuffer(b"LN", np.uint8)).astype(np.uint8) * _LETTER
    out[ord("_")] = _LETTER
    out[[ord(c) for c in "'-"]] = _JOINT
    out[[ord(c) for c in " \t\n\f\r"]] = _SPACE
    out[[ord(c) for c in ".!?"]] = _STOP
    return out


def _many(lowered: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """measures() of texts that are in lower case, without white space at their ends, as arrays."""
    for rows, points, offs in arrays.stretches([t + "\n" for t in lowered]):
        kind, docs = _classes()[points], rows.stop - rows.start
        size = len(points)
        # Words: runs of letters and joints (none at a text's end, which is a line feed) from the first letter to the last.
        letter, inside = kind == _LETTER, (kind & (_LETTER | _JOINT)) > 0
        at = np.flatnonzero(letter)
        gap = np.concatenate(([0], np.cumsum(~inside)))  # same number: same run
        run = gap[at]
        first = np.concatenate(([True], run[1:] != run[:-1]))[: len(at)]
        start, end = at[first], at[np.concatenate((first[1:], [True]))[: len(at)]] + 1
        word_offs = np.searchsorted(start, offs)
        count = np.diff(word_offs)
        # Moving diversity: a word adds to the windows that start behind its last place.
        hashes = arrays.span_hashes(points, start, end)
        doc = np.repeat(np.arange(docs), count)
        place = np.arange(len(start)) - word_offs[:-1][doc]
        own = hashes ^ arrays.scramble(doc)
        order = np.argsort(own, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = own[order][1:] == own[order][:-1]
        behind = np.zeros(len(order), np.int64)
        behind[order[1:][same[1:]]] = place[order[:-1][same[1:]]] + 1
        n = count[doc]
        short = n <= WINDOW
        adds = np.where(short, behind == 0, np.maximum(0, np.minimum(place, n - WINDOW) - np.maximum(place - WINDOW + 1, behind) + 1))
        total = arrays.sums(adds.astype(np.int64), word_offs)
        diversity = np.where(count <= WINDOW, total / np.maximum(count, 1), total / WINDOW / np.maximum(count - WINDOW + 1, 1))
        # Sentences end at a line feed, and behind marks that white space follows; those marks are in no sentence.
        stop, line, space = kind == _STOP, points == 10, kind == _SPACE
        space[offs[1:] - 1] = False  # nothing follows a text's last marks
        follows = np.concatenate((np.where(stop, size, np.arange(size)), [size]))
        behind_stops = np.minimum.accumulate(follows[::-1])[::-1][:size]  # first place from here on that holds no mark
        cut = stop & space[np.minimum(behind_stops, size - 1)] & (behind_stops < size)
        border = line | cut
        text = ~space & ~cut & ~line
        sentence = np.cumsum(border)  # a sentence has the number of the border before it
        own = sentence[text]
        begin = np.flatnonzero(text)[np.concatenate(([True], own[1:] != own[:-1]))[: len(own)]]
        sentence_doc = np.searchsorted(offs, begin, "right") - 1
        n_sentences = np.bincount(sentence_doc, minlength=docs)[:docs]
        # Burstiness over sentences with words.
        word_sentence = sentence[start] if len(start) else start
        which, sizes = np.unique(word_sentence, return_counts=True)
        of = doc[np.searchsorted(word_sentence, which)] if len(which) else which
        k = np.bincount(of, minlength=docs)[:docs]
        mean = count / np.maximum(k, 1)
        spread = np.bincount(of, (sizes - mean[of]) ** 2, docs)[:docs]
        yield count, n_sentences, diversity, np.where(k > 1, np.sqrt(spread / np.maximum(k - 1, 1)) / np.maximum(mean, 1e-300), np.nan)


def style_measures(df: DataFrame, text_col: str = "text", out_col: str = "style") -> DataFrame:
    """df with a struct: n_words, n_sentences, mattr, burstiness_cv, and hits (counts of the markers in their order).

    One pass over the text, no shuffle.  Words are told apart by 64-bit hashes.
    A null text is an empty one; burstiness_cv is null without two sentences
    that have words.
    """

    @F.arrow_udf("struct<n_words: bigint, n_sentences: bigint, mattr: double, burstiness_cv: double, hits: array<bigint>>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.cast(pa.large_string()).fill_null("")
            n = len(texts)
            out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.nan)]
            values = texts.to_pylist()
            lowered = [t.lower() for t in values]
            apart = np.array([len(a) != len(b) or _APART.search(a) is not None for a, b in zip(values, lowered, strict=True)], bool)
            together = np.flatnonzero(~apart)
            at = 0
            for part in _many([lowered[i].rstrip() for i in together.tolist()]):
                rows = together[at : at + len(part[0])]
                at += len(rows)
                for column, value in zip(out, part, strict=True):
                    column[rows] = value
            for i in np.flatnonzero(apart).tolist():
                out[0][i], out[1][i], out[2][i], cv = measures(values[i])
                out[3][i] = np.nan if cv is None else cv
            columns = [*map(pa.array, out[:3]), pa.array(out[3], from_pandas=True), _marker_counts(texts)]
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_sentences", "mattr", "burstiness_cv", "hits"])

    return df.withColumn(out_col, measure.asNondeterministic()(F.col(text_col).cast("string")))


def _marked(texts: pa.Array) -> np.ndarray:
    """Rows that hold any marker."""
    return np.flatnonzero(pc.match_substring_regex(texts, _ANY_MARKER).to_numpy(zero_copy_only=False))


def _marker_counts(texts: pa.Array) -> pa.Array:
    """Of each text, how often each marker occurs."""
    counts = np.zeros((len(texts), len(MARKERS)), np.int64)
    rows = _marked(texts)
    if len(rows):
        some = texts.take(pa.array(rows))
        for k, (pattern, _, _) in enumerate(MARKERS):
            counts[rows, k] = pc.count_substring_regex(some, "(?i)" + pattern).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(MARKERS)), pa.array(counts.ravel()))


_MARKER_HIT = pa.struct([("phrase", pa.string()), ("count", pa.int64()), ("weight", pa.float64()), ("samples", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def marker_matches(df: DataFrame, text_col: str = "text", out_col: str = "markers", samples: int = 3, spans: int = 10) -> DataFrame:
    """df with an array of the markers found, in their order: phrase, count, weight, the first samples, and the first spans (code points, end exclusive).

    A null text has none.  One pass, no shuffle; only texts with a marker become
    Python strings.
    """

    @F.arrow_udf("array<struct<phrase: string, count: bigint, weight: double, samples: array<string>, spans: array<struct<start: int, end: int>>>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.cast(pa.large_string()).fill_null("")
            out: list[list[dict]] = [[]] * len(texts)
            rows = _marked(texts)
            some = texts.take(pa.array(rows, pa.int64()))
            per = [pc.count_substring_regex(some, "(?i)" + p).to_numpy(zero_copy_only=False) for p, _, _ in MARKERS]
            for at, i in enumerate(rows.tolist()):
                text = some[at].as_py()
                out[i] = []
                for k, (_, label, weight) in enumerate(MARKERS):
                    if per[k][at]:
                        found = [m.span() for m in _MARKERS[k].finditer(text)]
                        out[i].append({"phrase": label, "count": len(found), "weight": weight, "samples": [text[a:b] for a, b in found[:samples]], "spans": [{"start": a, "end": b} for a, b in found[:spans]]})
            yield pa.array(out, pa.list_(_MARKER_HIT))

    return df.withColumn(out_col, find.asNondeterministic()(F.col(text_col).cast("string")))


def _ladder(value: Column, steps: list[tuple[float, object]], otherwise, at_least: bool) -> Column:
    out = None
    for bound, result in steps:
        test = value >= bound if at_least else value < bound
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(otherwise)


def style_score(style: Column) -> dict[str, Column]:
    """Columns density, score, density_tier, confidence_level and status from a ``style`` struct."""
    # The ladders, weights and tiers below.
    n, cv = style["n_words"], style["burstiness_cv"]
    weights = F.array(*(F.lit(w) for _, _, w in MARKERS))
    weight = F.aggregate(F.zip_with(style["hits"], weights, lambda h, w: h * w), F.lit(0.0), lambda a, b: a + b)
    enough = n >= MIN_WORDS
    density = F.when(enough, weight / (n / F.lit(100.0)))
    dense = _ladder(density, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.45)], F.when(density > 0, 0.20).otherwise(0.0), True)
    burst = _ladder(cv, [(0.25, 0.95), (0.35, 0.80), (0.45, 0.50), (0.55, 0.25)], 0.05, False)
    diverse = F.when(style["mattr"].between(0.68, 0.76), 0.4).otherwise(0.1)
    whole = F.when(cv.isNotNull(), burst * 0.45 + dense * 0.45 + diverse * 0.10).otherwise((dense * 0.45 + diverse * 0.10) / 0.55)
    damp = F.when(n < FULL_WORDS, 0.4 + 0.6 * (n - MIN_WORDS) / float(FULL_WORDS - MIN_WORDS)).otherwise(1.0)
    score = F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole * damp)))
    return {
        "status": F.when(enough, "ok").otherwise("insufficient_length"),
        "density": density,
        "score": score,
        "density_tier": F.when(score.isNull(), "uncalibrated").otherwise(_ladder(score, [(0.65, "high"), (0.4, "medium")], "low", True)),
        "confidence_level": F.when(score.isNotNull(), _ladder(score, [(0.75, "HIGH"), (0.5, "MEDIUM"), (0.25, "LOW")], "CLEAN", True)),
    }
