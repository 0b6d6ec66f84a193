"""SentencePiece encoding and decoding: shared-prefix Viterbi over a trie of distinct marked words.

A text's words, each with its spaces as marks before it, are segmented once per
distinct word.  Distinct words are sorted, which lays out their trie depth
first; the forward scores of the prefix that a word shares with the one before
it are kept, and only the rest of the word is worked out.  The forward score of
a prefix is the best total score of pieces that spell it; the last piece of that
segmentation leads back.

Viterbi gives the ids of unigram models.  For a BPE model it gives the
segmentation of the best total score of its pieces, which is not what merging
gives; its merge ids come from the SentencePiece library, again once per
distinct word, and stand beside the others.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .tokens import PieceIds

MARK = "▁"
#: How far an unknown character's score lies under the least piece's (a fixed value of the format).
UNKNOWN_PENALTY = 10.0


class SentencePieceModel:
    """Pieces and settings of a serialized model; encodes marked words."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(data)
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave text as it is are supported")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("models with pieces of the user's own are not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_score = min(self.score.values()) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a mark behind other characters; words can't be cut there")
        # Pieces read from their ends, as nested tables; None leads to the score of the piece that is complete there.
        self.endings: dict = {}
        for piece, score in self.score.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = score
        model.normalizer_spec.add_dummy_prefix = False
        self._plain, self._library = model.SerializeToString() if self.bpe else b"", None

    @classmethod
    def load(cls, vocabulary: str) -> SentencePieceModel:
        with open(public_tokenizers.path(vocabulary), "rb") as file:
            return cls(file.read())

    def segment(self, words: list[str]) -> list[list[str]]:
        """Segmentations of the best total score, in the order of words; of equal ones the longest last piece, back from the end."""
        out: list[list[str]] = [[]] * len(words)
        # best[i]: the best total of the first i characters; back[i]: where the last piece of that segmentation starts.
        best: list[float] = [0.0]
        back: list[int] = [0]
        before = ""
        endings, unknown = self.endings, self.unknown_score
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, node, known = end - 1, endings, False
                top, origin = -np.inf, end - 1
                while start >= 0:
                    node = node.get(word[start])
                    if node is None:
                        break
                    score = node.get(None)
                    if score is not None:
                        known = known or start == end - 1
                        value = best[start] + score
                        if value >= top:
                            top, origin = value, start
                    start -= 1
                if not known and best[end - 1] + unknown > top:  # a character that is no piece stands alone
                    top, origin = best[end - 1] + unknown, end - 1
                best.append(top)
                back.append(origin)
            before, end, parts = word, len(word), []
            while end:
                parts.append(word[back[end] : end])
                end = back[end]
            out[at] = parts[::-1]
        return out

    def ids(self, parts: list[str]) -> list[int]:
        """Ids of pieces; unknown characters are spelled in bytes, or else neighbouring ones are one unknown id."""
        out: list[int] = []
        for part in parts:
            if part in self.id:
                out.append(self.id[part])
            elif self.byte:
                out += [self.byte[b] for b in part.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids that a BPE model's merges give, by the library."""
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self._plain)
        return self._library.encode(words, num_threads=1)

    def marked(self, text: str) -> str:
        marked = text.replace(" ", MARK)
        return MARK + marked if self.dummy_prefix and text else marked

    def words(self, text: str) -> list[str]:
        """Marked words: runs of marks, each with the characters up to the next mark."""
        marked, out, at = self.marked(text), [], 0
        for i in range(1, len(marked)):
            if marked[i] == MARK and marked[i - 1] != MARK:
                out.append(marked[at:i])
                at = i
        return [*out, marked[at:]] if marked else []

    def encode(self, text: str) -> list[int]:
        return self.ids([part for parts in self.segment(self.words(text)) for part in parts])

    def merge(self, text: str) -> list[int]:
        return self.merged([self.marked(text)])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids that stand for no text nothing."""
        value = {i: b for b, i in self.byte.items()}
        out = bytearray()
        for i in ids:
            out += bytes([value[i]]) if i in value else self.pieces[i].replace(MARK, " ").encode() if self.pieces[i] in self.id else b""
        text = out.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.cache
def _worker(vocabulary: str) -> tuple[SentencePieceModel, PieceIds]:
    """The model and the ids of words met so far (their Viterbi ids behind the number of these, then their merge ids), for as long as a Python worker lives."""
    model = SentencePieceModel.load(vocabulary)

    def new(pieces: list[bytes]) -> list[np.ndarray]:
        words = [p.decode("utf-8", "replace").replace(" ", MARK) for p in pieces]
        ids = [model.ids(parts) for parts in model.segment(words)]
        merged = model.merged(words) if model.bpe else [[]] * len(words)
        return [np.array([len(a), *a, *b], np.uint32) for a, b in zip(ids, merged, strict=True)]

    return model, PieceIds(new, 1_000_000)


def _spaced_words(block: kernel.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of words with the U+0020s before them, and documents' offsets; other white space is part of words."""
    space = block.buf == 0x20
    before = np.concatenate(([False], space[:-1])) if len(space) else space
    edge = np.zeros(len(space) + 1, bool)
    edge[block.offs] = True
    start = np.flatnonzero(edge[:-1] | (space & ~before))
    return start, np.concatenate((start[1:], [len(space)])) if len(start) else start, np.searchsorted(start, block.offs)


class _Spelled:
    """The bytes of each id, for decoding by gathers."""

    def __init__(self, model: SentencePieceModel):
        value = {i: bytes([b]) for b, i in model.byte.items()}
        parts = [value.get(i, p.replace(MARK, " ").encode() if p in model.id else b"") for i, p in enumerate(model.pieces)]
        self.size = np.array([len(s) for s in parts])
        self.letters, self.begin = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(self.size)[:-1]))

    def text(self, ids: np.ndarray, cut: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids' bytes, and the offsets of documents into them."""
        size = self.size[ids]
        return self.letters[kernel.ragged(self.begin[ids], size)].tobytes(), np.concatenate(([0], np.cumsum(size)))[cut]


def _column(ids: np.ndarray, cut: np.ndarray, back: bytes, back_cut: np.ndarray, raw: bytes, offs: np.ndarray, odd: dict[int, tuple[list[int], bool]]) -> list[tuple[np.ndarray, bool]]:
    """Each document's ids, and whether they decode to its text; ``odd`` has those that were worked out apart."""
    out = []
    for i in range(len(offs) - 1):
        if i in odd:
            out.append((np.array(odd[i][0], np.uint32), odd[i][1]))
        else:
            out.append((ids[cut[i] : cut[i + 1]], back[back_cut[i] : back_cut[i + 1]] == raw[offs[i] : offs[i + 1]]))
    return out


def sentencepiece_encode(df: DataFrame, *, text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", with_ids: bool = True, out_col: str = "pieces") -> DataFrame:
    """df with a struct column ``out_col``: n_ids, ids_crc32, ids, round_trip, and the same with bpe_ before.

    The first four are of the Viterbi segmentation of the whole text, the best
    total of the pieces' scores; the others of a BPE model's merges, equal to
    the library's (null for a unigram model).  No special ids are added;
    ids_crc32 is of the little-endian unsigned 32-bit form, round_trip tells
    whether decoding the ids gives the text back (false where the text holds
    marks of its own, which decode to spaces).  The ids are null unless with_ids.
    A null text is an empty one and has no ids; very long texts are encoded
    whole.  Narrow; rows, repeated ones too, and other columns are kept, a column
    named ``out_col`` is replaced; an empty table stays empty.
    """
    fields = "n_ids: bigint, ids_crc32: bigint, ids: array<int>, round_trip: boolean"

    @F.arrow_udf(f"struct<{fields}, {', '.join('bpe_' + f for f in fields.split(', '))}>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = _worker(vocabulary)
        spelled, mark = _Spelled(model), MARK.encode()
        for texts in batches:
            found: list[list[tuple[np.ndarray, bool]]] = [[], []]
            for plain in kernel.blocks(texts):
                block = _with_dummies(plain) if model.dummy_prefix else plain
                start, end, offs = _spaced_words(block)
                raw = block.buf.tobytes()
                odd: list[dict[int, tuple[list[int], bool]]] = [{}, {}]
                for i in range(block.n) if mark in raw else ():  # marks of a text's own: rare, and cut words elsewhere
                    if mark in raw[block.offs[i] : block.offs[i + 1]]:
                        text = plain.text(plain.offs[i], plain.offs[i + 1])
                        for own, of in zip(odd, (model.encode, model.merge) if model.bpe else (model.encode,), strict=False):
                            own[i] = (ids := of(text), model.decode(ids) == text)
                slot = known.slots(block.buf, start, end)
                at, size = known.start[slot], known.size[slot]
                first = known.ids[at].astype(np.int64)
                for k, (begin, count) in enumerate([(at + 1, first), (at + 1 + first, size - 1 - first)][: 1 + model.bpe]):
                    ids = known.ids[kernel.ragged(begin, count)]
                    cut = np.concatenate(([0], np.cumsum(kernel.fold(count, offs))))
                    if not model.byte:  # neighbouring unknowns are one, across words too
                        keep = np.ones(len(ids), bool)
                        keep[1:] = (ids[1:] != model.unknown) | (ids[:-1] != model.unknown)
                        keep[cut[:-1][cut[:-1] < len(ids)]] = True
                        cut = np.concatenate(([0], np.cumsum(keep)))[cut]
                        ids = ids[keep]
                    found[k] += _column(ids, cut, *spelled.text(ids, cut), raw, block.offs, odd[k])
            columns = []
            for part in found:
                n = len(texts)
                if not part and n:
                    columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.bool_())]
                    continue
                ids_column = pa.array([i.astype(np.int32) for i, _ in part], pa.list_(pa.int32())) if with_ids else pa.nulls(n, pa.list_(pa.int32()))
                columns += [pa.array([len(i) for i, _ in part], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i, _ in part], pa.int64()), ids_column, pa.array([ok for _, ok in part], pa.bool_())]
            names = [f.split(":")[0] for f in fields.split(", ")]
            yield pa.StructArray.from_arrays(columns, [*names, *("bpe_" + name for name in names)])

    return df.withColumn(out_col, encode(F.col(text_col).cast("string")))


def _with_dummies(block: kernel.Block) -> kernel.Block:
    """The block with a space before every document that isn't empty."""
    full = np.diff(block.offs) > 0
    offs = block.offs + np.concatenate(([0], np.cumsum(full)))
    buf = np.full(offs[-1], 0x20, np.uint8)
    buf[np.arange(len(block.buf)) + np.repeat(np.cumsum(full), np.diff(block.offs))] = block.buf
    return kernel.Block(buf, offs, block.first)


def sentencepiece_decode(df: DataFrame, *, ids_col: str = "ids", vocabulary: str = "piece_bpe_32k.model", out_col: str = "text") -> DataFrame:
    """df with ``out_col``: the text of an array of ids (null for null; null and unknown ids stand for nothing).

    Rows and other columns are kept, a column named ``out_col`` is replaced.
    """

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, _ = _worker(vocabulary)
        for column in batches:
            yield pa.array([None if ids is None else model.decode([i for i in ids if i is not None and 0 <= i < len(model.pieces)]) for ids in column.to_pylist()], pa.string())

    return df.withColumn(out_col, decode(F.col(ids_col)))
