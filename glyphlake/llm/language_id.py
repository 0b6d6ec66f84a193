"""Language identification by prediction by partial matching (PPM).

Each language has trees of byte contexts of up to three bytes with frozen
counts.  A byte's probability comes from the longest context known to the
language, with method C escape probabilities and full exclusion down to a
uniform last order, so the sum of -log2 over a text is the exact length of its
PPM code.  As the counts are frozen, the cost of a byte depends on the three
bytes before it alone: each distinct run of four bytes is worked out once, and
kept in a table of bounded size that is found by hash.  The smallest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .scratch import Scratch

UNDETERMINED = "und"
#: Bytes of a worker's table of costs that were worked out before.
TABLE_BYTES = 32 << 20
#: Bytes of all languages' samples together.
SAMPLE_BYTES = 32 << 20
#: Runs of four bytes that a model counted over whole tables keeps, of all languages together; the most frequent if there are more.
MAX_RUNS = 1 << 21
#: More distinct labels than this are no languages: an error.
MAX_LANGUAGES = 4096
#: Bytes scored at a time.
_STRETCH = 1 << 20


def _grams(buf: np.ndarray, offs: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """The run of four bytes that ends at each place in [a, b), as one number; 0xFF, which UTF-8 never has, stands before a text."""
    b = len(buf) if b is None else b
    own = np.full(b - a + 3, 0xFF, np.uint32)
    low = max(a - 3, 0)
    own[3 - (a - low) :] = buf[low:b]
    out = own[3:].copy()
    starts = np.unique(offs[:-1])
    for back in (1, 2, 3):
        before = own[3 - back : len(own) - back].copy()
        for after in range(back):  # places less than ``back`` bytes behind a text's start
            at = starts + after - a
            before[at[(at >= 0) & (at < b - a)]] = 0xFF
        out |= before << np.uint32(8 * back)
    return out


class _Tree:
    """Counts of one language: of each order, the runs that occur, and of each context its total, kinds, and what its symbols total one order lower."""

    def __init__(self, grams: np.ndarray, times: np.ndarray | None = None):
        """From every run of four bytes, or from distinct ones and how often each stands."""
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, ...]] = []
        for order in range(4):
            own = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            if times is None:
                run, count = np.unique(own, return_counts=True)
            else:
                run, place = np.unique(own, return_inverse=True)
                count = np.bincount(place, times, len(run))
            count = count.astype(np.float64)
            context, first = np.unique(run >> np.uint32(8), return_index=True)
            lower = np.zeros(len(run))
            if order:
                keys, below = self.runs[-1]
                lower = below[np.searchsorted(keys, run & np.uint32((1 << 8 * order) - 1))]
            sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            self.runs.append((run, count))
            self.contexts.append((context, sums(count), sums(np.ones(len(run))), sums(lower)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each run after the three before it."""
        n = len(grams)
        out, spent, open_ = np.zeros(n), np.zeros(n), np.ones(n, bool)
        gone, gone_kinds = np.zeros(n), np.zeros(n)  # what higher orders exclude
        for order in (3, 2, 1, 0):
            own = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            count = _found(own, self.runs[order][0], self.runs[order][1])
            total, kinds, lower = (_found(own >> np.uint32(8), self.contexts[order][0], x) for x in self.contexts[order][1:])
            left, left_kinds = total - gone, kinds - gone_kinds
            whole = np.log2(np.maximum(left + left_kinds, 1))
            seen = open_ & (count > 0)
            out[seen] = spent[seen] + whole[seen] - np.log2(count[seen])
            open_ &= ~seen
            spent += np.where(left_kinds > 0, whole - np.log2(np.maximum(left_kinds, 1)), 0)
            gone, gone_kinds = np.where(total > 0, lower, gone), np.where(total > 0, kinds, gone_kinds)
        return np.where(open_, spent + np.log2(np.maximum(256 - gone_kinds, 1)), out)


def _found(wanted: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class PpmModel:
    """Frozen context trees of several languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        self.trees = []
        for x in self.languages:
            texts = [t for t in samples[x] if t]
            offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            self.trees.append(_Tree(_grams(np.frombuffer(b"".join(texts), np.uint8), offs)))
        self._known: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
        """From each language's distinct runs of four bytes and their counts."""
        out = cls({})
        out.languages = sorted(counts)
        out.trees = [_Tree(*counts[x]) for x in out.languages]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": None}

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """(language, run): bits of the last byte of each run."""
        return np.stack([tree.bits(grams) for tree in self.trees])

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each document under each language."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        if self._known is None:  # 0xFFFFFFFF is no run: its last byte can't be
            slots = max(12, (TABLE_BYTES // (4 * (len(self.languages) + 1))).bit_length() - 1)
            self._known = np.full(1 << slots, 0xFFFFFFFF, np.uint32), np.zeros((len(self.languages), 1 << slots), np.float32)
        keys, known = self._known
        shift = np.uint32(33 - len(keys).bit_length())
        for a in range(0, len(buf), _STRETCH):
            b = min(a + _STRETCH, len(buf))
            grams = _grams(buf, offs, a, b)
            slot = (grams * np.uint32(0x9E3779B1)) >> shift
            lost = np.flatnonzero(keys[slot] != grams)
            new, place = np.unique(grams[lost], return_inverse=True)
            costs = self.costs(new) if len(new) else None
            inside = np.clip(offs, a, b) - a
            some = np.flatnonzero(np.diff(inside))
            for k in range(len(self.languages)):
                cost = known[k][slot]
                if costs is not None:
                    cost[lost] = costs[k][place]
                out[some, k] += np.add.reduceat(cost, inside[some], dtype=np.float64)
            if costs is not None:
                to = (new * np.uint32(0x9E3779B1)) >> shift
                keys[to] = new
                last = keys[to] == new  # of runs with one slot the last stays
                known[:, to[last]] = costs[:, last]
        return out


def has_letter(block: kernel.Block) -> np.ndarray:
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    out = kernel.fold(letter[block.buf].astype(np.int64), block.offs) > 0
    for i in np.flatnonzero(~out & (np.diff(block.offs) > 0)).tolist():
        out[i] = any(c.isalpha() for c in block.text(block.offs[i], block.offs[i + 1]))
    return out


def _thinned(docs: DataFrame, condition, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """(lang, h, text) of about ``per_language`` distinct (id, text) of each language, or all of them, drawn by hash; and the number of languages.

    The rate of a language follows from the estimated number of its distinct (id,
    text), so copies neither crowd others out nor can all miss the draw.
    """
    rows = docs.where(condition).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna().where("text <> ''")
    rows = rows.select("lang", F.xxhash64("id", "text").alias("h"), "text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).limit(MAX_LANGUAGES + 1).toPandas()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spark = docs.sparkSession
    if counts.empty:
        return spark.createDataFrame([], "lang string, h long, text string"), 0
    rate = F.broadcast(spark.createDataFrame(counts).select("lang", (F.lit(float(per_language << 40)) / F.col("count")).alias("rate")))
    drawn = rows.join(rate, "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < F.col("rate"))
    return drawn.select("lang", "h", "text"), len(counts)


def train_language_model(
    docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, bytes_per_language: int = 1 << 20, max_chars: int = 50_000
) -> PpmModel:
    """Context trees of every language of the rows where ``learn`` holds, from a bounded sample.

    Of each language up to docs_per_language distinct (id, text) are learned, in
    the order of a hash of both, as far as bytes_per_language goes (less if
    there are so many languages that all samples would exceed SAMPLE_BYTES), one
    at least.  Of a text of over max_chars characters a stretch of that length is
    learned, at a place given by the hash.  Rows with null id, text or language
    and empty texts teach nothing; repeated rows teach once.  Without any row to
    learn from, the model knows no language.  More than MAX_LANGUAGES are refused.
    """
    # Four times the sample is drawn, then ranked: no rank runs over all rows.
    drawn, languages = _thinned(docs, learn, 4 * docs_per_language, id_col, text_col, lang_col)
    if not languages:
        return PpmModel({})
    size = F.length("text")
    stretch = F.when(size > max_chars, F.substring(F.col("text"), (F.pmod("h", size - max_chars + 1) + 1).cast("int"), F.lit(max_chars))).otherwise(F.col("text"))
    drawn = drawn.withColumn("text", stretch).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    ranked = drawn.withColumns({"n": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    most = min(bytes_per_language, SAMPLE_BYTES // languages)
    picked = ranked.where((F.col("n") == 1) | (F.col("n") <= docs_per_language) & (F.col("bytes") <= most)).select("lang", "n", "text").toPandas()
    picked = picked.sort_values(["lang", "n"])
    return PpmModel({lang: [t.encode() for t in part["text"]] for lang, part in picked.groupby("lang")})


def _labelled(docs: DataFrame, condition, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, h, text) of the rows with an id, a text and a language; h is a hash of the text."""
    rows = docs.where(condition).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna().where("text <> ''")
    return rows.select("lang", F.xxhash64("text").alias("h"), "text")


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, run of four bytes, how often it stands)."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (run, count) in held.items():
            for at in range(0, len(run), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run[part]), pa.string()), pa.array(run[part].astype(np.int64)), pa.array(count[part])], ["lang", "run", "times"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            for block in kernel.blocks(batch.column(1).filter(pa.array(langs == lang))):
                for at in range(0, len(block.buf), _STRETCH):
                    run, count = np.unique(_grams(block.buf, block.offs, at, min(at + _STRETCH, len(block.buf))), return_counts=True)
                    if lang in held:
                        run, place = np.unique(np.concatenate((held[lang][0], run)), return_inverse=True)
                        count = np.bincount(place, np.concatenate((held[lang][1], count))).astype(np.int64)
                    held[lang] = run, count
        if sum(len(run) for run, _ in held.values()) > MAX_RUNS:
            yield from out()
    yield from out()


def count_language_model(docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """Context trees of every language, counted over the whole of all rows where ``learn`` holds.

    A text teaches a language once, however many rows hold it.  Rows with null
    id, text or language and empty texts teach nothing; without any other the
    model knows no language.  More than MAX_LANGUAGES are refused.  If the
    languages have more than MAX_RUNS distinct runs of four bytes, each keeps its
    most frequent ones, with their counts over all texts.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = _labelled(docs, learn, id_col, text_col, lang_col).dropDuplicates(["lang", "h"]).select("lang", "text")
    counted = texts.mapInArrow(kernel.lean(_count_runs), "lang string, run long, times long").groupBy("lang", "run").agg(F.sum("times").alias("times"))
    counted = scratch.table(counted)
    found = counted.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return PpmModel({})
    names = sorted(r["lang"] for r in found)
    kept = counted
    if sum(r["count"] for r in found) > MAX_RUNS:
        order = Window.partitionBy("lang").orderBy(F.desc("times"), "run")
        kept = counted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_RUNS // len(names))
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "number int, lang string"))
    table = kept.join(numbers, "lang").select("number", "run", "times").toArrow()
    number, run, times = (table.column(i).to_numpy() for i in range(3))
    scratch.drop(counted)
    scratch.release()
    return PpmModel.of_counts({lang: (run[number == i].astype(np.uint32), times[number == i]) for i, lang in enumerate(names)})


def identify_language(df: DataFrame, model: PpmModel | Broadcast, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """df with a struct column ``out_col``: lang_pred, score, bits_per_byte.

    lang_pred is the language with the shortest code of the whole text (ties to
    the first name), score its posterior under equal priors.  A null text, one
    without a letter, or any text under a model that has learned nothing is
    ``und`` with score 0.  Very long texts are coded whole.  Narrow; rows,
    repeated ones too, and other columns are kept, a column named ``out_col`` is
    replaced; an empty table stays empty.
    """
    shared = model if isinstance(model, Broadcast) else df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    @kernel.lean
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for texts in batches:
            best, score, rate = [], [], []
            for block in kernel.blocks(texts):
                known = has_letter(block) & bool(m.languages)
                if m.languages:
                    bits = m.bits(block.buf, block.offs)
                    win = np.where(known, bits.argmin(1), len(m.languages))
                    least = bits.min(1)
                    score.append(np.where(known, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0))
                    rate.append(least / np.maximum(np.diff(block.offs), 1))
                else:
                    win = np.zeros(block.n, np.int64)
                    score.append(np.zeros(block.n))
                    rate.append(np.zeros(block.n))
                best.append(names[win])
            cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            yield pa.StructArray.from_arrays([cat(best, pa.string()), cat(score, pa.float64()), cat(rate, pa.float64())], ["lang_pred", "score", "bits_per_byte"])

    return df.withColumn(out_col, predict(F.col(text_col).cast("string")))


class RateLimits:
    """Bits a byte above which a text is in no language of the model: of each language, from its texts that were not learned.

    A text of n bytes may lie over the median rate by three times what the 99th
    percentile does, and by three deviations of a byte over the root of n.
    Languages of fewer than LEAST texts take all languages' figures; without any
    text nothing is rejected.
    """

    LEAST = 20

    def __init__(self, pooled: tuple[float, float] | None, by_language: dict[str, tuple[float, float]]):
        """Of all languages and of each: the median rate with its allowance, and the allowance that shrinks with a text's length."""
        self.pooled, self.by_language = pooled, by_language

    def exceeded(self, lang_pred, rate, n_bytes):
        """Columns to a column: whether the rate is over the predicted language's limit."""
        if self.pooled is None:
            return F.lit(False)
        of = lambda figures: figures[0] + figures[1] / F.sqrt(F.greatest(n_bytes, F.lit(1)))
        limit = of(self.pooled)
        for lang, figures in self.by_language.items():
            limit = F.when(lang_pred == lang, of(figures)).otherwise(limit)
        return rate > limit


#: Steps of a bit a byte, and of the logarithm of a deviation, in which held-out texts are counted.
_RATE_STEPS, _DEVIATION_STEPS = 1024, 1024


def _quantile(bins: np.ndarray, times: np.ndarray, q: float) -> int:
    """The bin that a share q of all reaches."""
    order = np.argsort(bins)
    total = np.cumsum(times[order])
    return int(bins[order][np.searchsorted(total, q * total[-1])])


def held_out_rates(docs: DataFrame, model: PpmModel | Broadcast, learn, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> RateLimits:
    """Limits from all distinct texts of the rows where ``learn`` does not hold; the same rows are ignored as for learning.

    Texts are counted by steps of their rates and deviations, so only the counts
    come to the driver.
    """
    scratch = Scratch(docs.sparkSession)
    found = identify_language(_labelled(docs, ~learn, id_col, text_col, lang_col), model).where(F.col("language.lang_pred") != UNDETERMINED)
    found = found.select("lang", "h", F.col("language.lang_pred").alias("pred"), F.col("language.bits_per_byte").alias("rate"), F.octet_length("text").alias("n"))
    found = scratch.table(found.dropDuplicates(["lang", "h"]).select("pred", "rate", "n"))
    rates = found.groupBy("pred", F.round(F.col("rate") * _RATE_STEPS).cast("int").alias("bin")).count().toPandas()
    if rates.empty:
        return RateLimits(None, {})
    parts: dict[str | None, tuple[float, float]] = {}
    for lang, part in [(None, rates), *rates.groupby("pred")]:
        if lang is None or part["count"].sum() >= RateLimits.LEAST:
            middle, high = (_quantile(part["bin"].to_numpy(), part["count"].to_numpy(), q) / _RATE_STEPS for q in (0.5, 0.99))
            parts[lang] = middle, middle + 3 * max(high - middle, 0.25)
    middles = docs.sparkSession.createDataFrame([("" if lang is None else f"={lang}", middle) for lang, (middle, _) in parts.items()], "group string, middle double")
    # Every text counts for its language and, under an empty name that no limit is asked for, for all.
    groups = found.select(F.explode(F.array(F.concat(F.lit("="), "pred"), F.lit(""))).alias("group"), "rate", "n").join(F.broadcast(middles), "group")
    step = F.round(F.log1p(F.abs(F.col("rate") - F.col("middle")) * F.sqrt("n")) * _DEVIATION_STEPS).cast("int")
    deviations = groups.groupBy("group", step.alias("bin")).count().toPandas()
    scratch.drop(found)
    figures = {}
    for group, part in deviations.groupby("group"):
        typical = float(np.expm1(_quantile(part["bin"].to_numpy(), part["count"].to_numpy(), 0.5) / _DEVIATION_STEPS))
        figures[group] = parts[group[1:] if group else None][1], 3 * 1.4826 * typical
    return RateLimits(figures[""], {group[1:]: x for group, x in figures.items() if group})
