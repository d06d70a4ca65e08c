"""Operator 1: SentencePiece encoding and decoding of BPE models, exactly and in linear time.

Encoding is by backtracking. An Aho-Corasick automaton finds every piece that
occurs in a stretch of text, which gives the longest piece at each place. The
encoder takes the longest piece, and steps down to shorter ones, while the new
piece is not compatible with the one before it; two neighbours are compatible
if merging their joined characters anew, best score first, gives the same two
pieces. Places from which no way leads on are marked in a bit field, so that
none is tried twice. The result is the one that merging the whole text would
give.

A text is cut before it is encoded, at places that no piece of the vocabulary
crosses (found from the vocabulary, not assumed): between a character and a
following space, and around characters that no piece holds. The stretches
repeat a lot, so each task keeps the codes of the short ones.

Defined results: null and empty text have no pieces and decode to "". Rows keep
their identifier, whatever it is, null included; repeated rows give repeated
results. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.llm.scratch import small_batches
from postworks.llm.words import text_chunks

SPACE = "▁"
#: Stretches up to this many characters are kept with their codes, so many at most in a worker; and checks of neighbours.
KEPT_CHARS, KEPT_STRETCHES, KEPT_PAIRS = 48, 700_000, 300_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Codec:
    """A SentencePiece BPE model with byte fallback, from the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix or {p.type for p in proto.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with byte fallback, a space put in front and no other normalisation are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.type == _CONTROL and p.piece == "</s>")
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.known = {p for p in self.id_of if len(p) == 1}
        # How each piece comes about by merging its own characters. One that doesn't can't occur in any result.
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.id_of:
            steps: list[tuple[str, str]] = []
            if len(p) > 1 and self.merge(p, steps) == [p]:
                self.parts[p] = steps[-1]
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the longest piece that a piece begins with
        for p in self.parts:
            self.automaton.add_word(p, len(p))
            self.shorter[p] = next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.parts)
        self.automaton.make_automaton()
        # Where pieces tie, or one scores better than a part of it, what neighbours do depends on more than the two of them.
        tied: dict[float, int] = {}
        for p in self.parts:
            tied[self.score[p]] = tied.get(self.score[p], 0) + 1
        odd = [p for p, ab in self.parts.items() if tied[self.score[p]] > 1 or any(x in self.parts and self.score[x] < self.score[p] for x in ab)]
        self.odd = re.compile("|".join(map(re.escape, odd)) or "(?!)")
        self.shown = [p.piece.replace(SPACE, " ") if p.type == _NORMAL else None for p in proto.pieces]
        self.cut, self.split = self._cuts()
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[tuple[int, ...], str]] = {}

    def _cuts(self) -> tuple[re.Pattern | None, re.Pattern]:
        """One pattern matches the stretches of a text, one splits a stretch further; no piece crosses either's borders."""
        inner = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        # A mark that follows a letter in some piece is no border; other characters that a mark follows are let be.
        letter = re.compile(r"[^\W\d_]")
        marks = [c for c in "!,.:;?|" if not any(b == c and a.isalpha() for a, b in inner)]
        before = sorted({a for a, b in inner if b in marks and letter.match(a)})
        split = re.compile(f"(?<=[^\\W\\d_{''.join(map(re.escape, before))}])(?=[{''.join(map(re.escape, marks))}])" if marks else "(?!)")
        cut = None
        if not any(a != SPACE and b == SPACE for a, b in inner):
            lone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.id_of))
            cut = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else ""))
        for p in self.id_of:
            if split.split(p) != [p] or cut and cut.findall(p) != [p]:
                raise ValueError(f"the piece {p!r} crosses a border of stretches")
        return cut, split

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """Merge neighbours, best score first and leftmost of equals, until no two make a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or (j := after[i]) >= len(parts) or parts[j] != right:
                continue
            if steps is not None:
                steps.append((left, right))
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives these two again.

        Steps are taken back, last one first, on the sides that face each other;
        before each step a merge across the border must not have been due.
        """
        score, parts = self.score, self.parts
        if left + right in score:
            return False
        while True:
            a, b = parts.get(left), parts.get(right)
            if b and (not a or score[right] <= score[left]):
                due, right = score[right], b[0]
                if score.get(left + right, -math.inf) >= due:  # of equals the left one is first
                    return False
            elif a:
                due, left = score[left], a[1]
                if score.get(left + right, -math.inf) > due:
                    return False
            else:
                return True

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a stretch of known characters."""
        if self.odd.search(text):
            return self.merge(text)
        longest = [1] * len(text)
        for end, n in self.automaton.iter(text):
            longest[end - n + 1] = n  # a later end is a longer piece
        fits, shorter = self.fits, self.shorter
        failed = bytearray(len(text) // 8 + 1)
        taken: list[str] = []
        at, piece = 0, text[: longest[0]]
        while True:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not taken:
                        break
                    pair = taken[-1], piece
                    if (known := fits.get(pair)) is None:
                        if len(fits) > KEPT_PAIRS:
                            fits.clear()
                        known = fits[pair] = self.compatible(*pair)
                    if known:
                        break
                piece = shorter.get(piece)
            if piece:
                taken.append(piece)
                at = end
                if at == len(text):
                    return taken
                piece = text[at : at + longest[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
                piece = shorter.get(piece)

    def stretch(self, text: str) -> tuple[tuple[int, ...], str]:
        """Ids of a stretch, and what they decode to."""
        if (found := self.kept.get(text)) is not None:
            return found
        if len(parts := self.split.split(text)) > 1:
            coded = [self.stretch(x) for x in parts]
            found = tuple(chain.from_iterable(x[0] for x in coded)), "".join([x[1] for x in coded])
        elif self.known.issuperset(text):
            ids = [self.id_of[p] for p in self.backtrack(text)]
            found = tuple(ids), "".join([self.shown[i] for i in ids])
        else:
            ids = []
            for run in re.split("([" + "".join(map(re.escape, set(text) - self.known)) + "])", text):
                if run in self.known or len(run) > 1:
                    ids += [self.id_of[p] for p in self.backtrack(run)]
                elif run:
                    ids += [self.byte_id[b] for b in run.encode()]
            found = tuple(ids), self.surface(ids)
        if len(text) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_STRETCHES:
                self.kept.clear()
            self.kept[text] = found
        return found

    def stretches(self, text: str | None) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return [self.kept.get(x) or self.stretch(x) for x in (self.cut.findall(text) if self.cut else [text])]

    def surface(self, ids) -> str:
        """The characters of pieces; runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.types[i] == _UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] != _CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        return [*chain.from_iterable(x[0] for x in self.stretches(text)), *([self.end_id] if end else [])]

    def decode(self, ids) -> str:
        text = self.surface(ids)
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text


_codecs: dict[int, Codec] = {}


def encode_decode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts, with an end id, and decode the ids: (id, ids array<int>, decoded string).

    The model file (of fixed size) is read on the driver and sent to the tasks.
    """
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model)
        codec = _codecs.get(key) or _codecs.setdefault(key, Codec(model))
        for whole in batches:
            for batch, _, _ in text_chunks(whole, "text"):
                ids, ends, decoded = [], [0], []
                for text in batch.column(1).to_pylist():
                    parts = codec.stretches(text)
                    own = np.fromiter(chain.from_iterable(x[0] for x in parts), np.int32)
                    ids += [own, [codec.end_id]]
                    ends.append(ends[-1] + len(own) + 1)
                    decoded.append("".join(x[1] for x in parts)[1:])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    id_type = df.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def digests(coded: DataFrame, id_column: str = "doc_id", *more: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode's result, with more of its columns if they are named."""
    return coded.select(
        F.col(id_column),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
