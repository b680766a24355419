"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled once on the driver into two transducers (``Fst``): from their start, arcs of weight zero read a
character each, and an empty arc back to the start writes an output and carries the weight.

- *Normaliser*: the rules of the model's character map, if it has one; the longest rule at a place goes, other characters
  are copied. Then, if the model says so, runs of spaces become one and those at either end go; a text that isn't
  empty gets a space in front, and U+2581 is a space.
- *Pieces*: each piece writes its ID. *Byte fallback* is an arc for any character that is no piece by itself, which writes the
  IDs of its UTF-8 bytes (in a model without such IDs, one unknown for each run of them).

A text's normal form is composed with the pieces on the fly, place by place, and the encoding is the tropical shortest path
through that lattice, found by one routine for both kinds of model. In a unigram model an arc weighs minus its piece's
score, the fallback 10 more than the worst piece. In a merge (BPE) model the state is the piece before, and an arc weighs 0
if a merge model would leave the two pieces as neighbours, infinity if not. It would leave them if, undoing
the merges on both sides of their border, no merge across the border would have come first. Each place is reached by
one path of finite weight, so the lattice needs one state for each place.

No piece has the mark for a space behind another character (``compile_model`` fails on a model for which this doesn't
hold), or two characters side by side that are so in no piece. So each path passes the places between such, and the
shortest path of a text is that of its stretches between these places, end to end; stretches are remembered, in
a table of bounded size.

Texts stay where they are: one pass without a shuffle. The compiled vocabulary (some 32,000 pieces) is broadcast; its
size is that of the model file, whatever the size of the corpus.

Defined cases: a null or empty text has no pieces; decoding gives back the normal form, which is the text with U+2581 read as
a space where the model has neither a character map nor removes spaces. ``round_trip`` tells whether it gave back the
text. Equal rows are encoded alike, row by row; a null doc_id is kept; an empty table gives an empty one; other
columns are ignored, whatever their names. A text longer than a batch of ``BATCH_BYTES`` is a batch by itself, encoded
whole. Models that write the mark behind words, or have symbols of their users, are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import pieces as cut

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BATCH_BYTES = 4 << 20
#: Stretches and pairs remembered by a task before it starts anew.
REMEMBERED = 500_000
#: What a character's bytes weigh more than the worst piece; a fixed value of the library.
UNLIKELY = 10.0
INFINITE = float("inf")

_STRETCH = re.compile(r" *[^ ]+| +")


class Fst:
    """A transducer made of chains that begin and end in its start.

    A state is a dict of its arcs. An arc, by the character it reads, is a list: the next state, and the output and
    weight with which the chain may end there (None and infinity where it may not).
    """

    _NONE: dict[str, list] = {}

    def __init__(self) -> None:
        self.start: dict[str, list] = {}

    def add(self, symbols: str, output, weight: float = 0.0) -> None:
        """A chain that reads ``symbols``."""
        arc = [self.start]
        for symbol in symbols:
            if arc[0] is self._NONE:
                arc[0] = {}
            arc = arc[0].setdefault(symbol, [self._NONE, None, INFINITE])
        arc[1:] = output, weight


class Normaliser:
    """The normal form of a text, with a space in front."""

    def __init__(self, rules: Iterable[tuple[str, str]] = (), squeeze: bool = False):
        self.fst, self.squeeze = Fst(), squeeze
        for source, target in rules:
            if source != target:
                self.fst.add(source, target)
        firsts = "".join(map(re.escape, self.fst.start))
        self.first = re.compile(f"[{firsts}]") if firsts else None

    def _mapped(self, text: str) -> str:
        """The text by the rules: at each place the longest that fits."""
        out, done = [], 0
        found = self.first.search(text)
        while found:
            place = found.start()
            out.append(text[done:place])
            arcs, target, done = self.fst.start, text[place], place + 1
            for end in range(place, len(text)):
                arc = arcs.get(text[end])
                if arc is None:
                    break
                arcs, output, _ = arc
                if output is not None:
                    target, done = output, end + 1
            out.append(target)
            found = self.first.search(text, done)
        out.append(text[done:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.first:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ").replace(MARK, " ").rstrip(" ")
            return " " + text if text else ""
        return " " + text.replace(MARK, " ")


class _Paths(dict):
    """The paths of stretches and their parts, as bytes; a stretch that isn't there yet is found when it is asked for."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find = find

    def __missing__(self, text: str) -> bytes:
        return self.find(text)


class Transducer:
    """The compiled model. Inside, the mark for a space is a plain space."""

    def __init__(
        self,
        ids: dict[str, int],
        scores: dict[str, float],
        byte_ids: list[int],
        unknown: int,
        merges: bool,
        normaliser: Normaliser | None = None,
    ):
        self.byte_ids, self.unknown, self.merges, self.scores = byte_ids, unknown, merges, scores
        self.normal = normaliser or Normaliser()
        self.surface: dict[int, bytes] = {i: p.encode() for p, i in ids.items()}
        for value, i in enumerate(byte_ids):
            self.surface[i] = bytes([value])
        self.surface.setdefault(unknown, b" \xe2\x81\x87 ")
        #: Of a piece that merges make: the two it is made of.
        self.halves: dict[str, tuple[str, str]] = {}
        if merges:
            self._undo_all(ids)
        #: Pieces with an arc; one that merging never makes has none.
        self.arcs = {p: i for p, i in ids.items() if not merges or len(p) == 1 or p in self.halves}
        self.pieces = {i: p for p, i in self.arcs.items()}
        self.size = max(self.pieces, default=0) + 1
        self.longest = max(map(len, self.arcs), default=0)
        self.lexicon = Fst()
        for piece, i in self.arcs.items():
            self.lexicon.add(piece, i, 0.0 if merges else -scores[piece])
        self.fallback = UNLIKELY - min(scores.values(), default=0.0)
        #: Neighbouring characters within a piece. Paths pass the place between any others.
        self.within = {a + b for p in self.arcs for a, b in zip(p, p[1:], strict=False)}
        self._ok: dict[int, bool] = {}
        self._known = _Paths(self._stretch)

    def __getstate__(self):
        return self.__dict__ | {"_ok": {}, "_known": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._known = _Paths(self._stretch)

    def _undo_all(self, ids: dict[str, int]) -> None:
        """The last merge of each piece, by merging its characters."""
        for piece in [p for p in ids if len(p) > 1]:
            parts = list(piece)
            while len(parts) > 1:
                best = min(
                    ((-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores),
                    default=None,
                )
                if best is None:
                    break
                i = best[1]
                if len(parts) == 2:
                    self.halves[piece] = (parts[0], parts[1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces ``a`` and ``b`` side by side."""
        if len(self._ok) >= REMEMBERED:
            self._ok.clear()
        found = self._ok[a * self.size + b] = self._left_apart(self.pieces[a], self.pieces[b])
        return found

    def _left_apart(self, a: str, b: str) -> bool:
        # Spines of pieces at the border, from one character up to the whole piece.
        left, right = [a], [b]
        while left[-1] in self.halves:
            left.append(self.halves[left[-1]][1])
        while right[-1] in self.halves:
            right.append(self.halves[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        rank = self.scores
        while True:
            across = rank.get(left[i] + right[j], -INFINITE)
            next_left = rank[left[i - 1]] if i else -INFINITE
            next_right = rank[right[j - 1]] if j else -INFINITE
            # Of merges of equal rank the one further left comes first.
            if across > next_left and across >= next_right:
                return False
            if not i and not j:
                return True
            if i and next_left >= next_right:
                i -= 1
            else:
                j -= 1

    def _path(self, text: str) -> array:
        """The shortest path through the lattice of one stretch."""
        first, longest, fallback = self.lexicon.start, self.longest, self.fallback
        merges, ok, size, n = self.merges, self._ok, self.size, len(text)
        # By place: its distance, the piece before it (-1: the fallback's arc) and where that begins.
        distance = [0.0] + [INFINITE] * n
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            so_far, before, arcs, end = distance[start], last[start], first, start
            for symbol in text[start : start + longest]:
                arc = arcs.get(symbol)
                if arc is None:
                    break
                arcs, piece, weight = arc
                end += 1
                if piece is not None and so_far + weight < distance[end]:
                    if merges and before >= 0:
                        pair = before * size + piece
                        # An arc between pieces that merging would not leave apart weighs infinity.
                        if not (ok[pair] if pair in ok else self.neighbours(before, piece)):
                            continue
                    distance[end], last[end], came[end] = so_far + weight, piece, start
            if so_far + fallback < distance[start + 1]:
                arc = first.get(text[start])
                if arc is None or arc[1] is None:
                    distance[start + 1], last[start + 1], came[start + 1] = so_far + fallback, -1, start
        out: list[int] = []
        end = n
        while end:
            start = came[end]
            if last[end] >= 0:
                out.append(last[end])
            elif self.byte_ids:
                out.extend([self.byte_ids[c] for c in reversed(text[start:end].encode())])
            else:
                out.append(self.unknown)
            end = start
        return array("i", reversed(out))

    def _stretch(self, text: str) -> bytes:
        """The path of a stretch that isn't known yet, from those of its parts."""
        known, within = self._known, self.within
        if len(known) >= REMEMBERED:
            known.clear()
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in within]
        if not cuts:
            path = known[text] = self._path(text).tobytes()
            return path
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[a:b]
            path = known.get(part)
            if path is None:
                path = known[part] = self._path(part).tobytes()
            out.append(path)
        path = known[text] = b"".join(out)
        return path

    def encode_into(self, text: str, out: array) -> None:
        """Add the pieces of a text to ``out``."""
        if not text:
            return
        begin = len(out)
        out.frombytes(b"".join(map(self._known.__getitem__, _STRETCH.findall(self.normal(text)))))
        if not self.byte_ids:
            added, unknown = out[begin:], self.unknown
            out[begin:] = array("i", (x for i, x in enumerate(added) if x != unknown or not i or added[i - 1] != unknown))

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode_bytes(self, ids) -> bytes:
        joined = b"".join(map(self.surface.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def compile_model(path: str = MODEL_PATH) -> Transducer:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    spec = proto.normalizer_spec
    if not (spec.add_dummy_prefix and spec.escape_whitespaces):
        raise ValueError("only models that put the mark for a space in front of a text")
    if proto.trainer_spec.model_type not in (1, 2) or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and merge models with marks in front")
    if any(piece.type == piece.USER_DEFINED for piece in proto.pieces):
        raise ValueError("only models without symbols of their users")
    rules = []
    if spec.precompiled_charsmap:
        rules = sentencepiece.SentencePieceNormalizer(normalizer_spec=spec.SerializeToString()).decompile()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i).replace(MARK, " "): i for i in normal}
    if any(re.search("[^ ] ", p) for p in ids):
        raise ValueError("a piece has the mark for a space behind another character")
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else []
    scores = {p: model.get_score(i) for p, i in ids.items()}
    normaliser = Normaliser(rules, spec.remove_extra_whitespaces)
    return Transducer(ids, scores, byte_ids, model.unk_id(), proto.trainer_spec.model_type == 2, normaliser)


def encode_documents(docs: DataFrame, model: Transducer | None = None) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip (decoding gives back the text) of each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or compile_model())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = shared.value
        for batch in cut(batches, "text", BATCH_BYTES):
            found = batch.column("text").to_pylist()
            ids = array("i")
            offsets = [0]
            for text in found:
                transducer.encode_into(text or "", ids)
                offsets.append(len(ids))
            flat = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)
            same = [
                transducer.decode_bytes(ids[a:b]) == (text or "").replace(MARK, " ").encode()
                for text, a, b in zip(found, offsets, offsets[1:], strict=False)
            ]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same)],
                ["doc_id", "token_ids", "n_tokens", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(rows: DataFrame, model: Transducer | None = None) -> DataFrame:
    """doc_id and text from doc_id and token_ids."""
    shared = rows.sparkSession.sparkContext.broadcast(model or compile_model())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "token_ids").mapInArrow(decoded, "doc_id long, text string")
