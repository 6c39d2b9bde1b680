"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position it
yields every piece that ends there, longest first, by following output links,
and each relaxes the best score of the prefix it completes (Viterbi).  A
character that is no piece scores ten below the lowest piece and is written as
its UTF-8 bytes.  On equal scores the longer last piece wins.

No piece goes on after a blank that follows another character, or over a line
feed, so the best segmentation of a text is that of its units, laid end to end;
each distinct unit is solved once and remembered within bounds.  Models with
pieces that break this rule are solved whole.

The installed model was trained by merges: its scores are ranks, not log
probabilities.  ``Pieces.load`` then scores a piece of rank r by a Zipf law,
-ln(r + 2); a unigram model keeps its own scores.

Encoding and decoding are exact inverses for every text: the meta symbol U+2581
of a text is written as bytes.  Null gives null, the empty text no pieces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Units whose pieces a task remembers, and characters of a unit worth it.
REMEMBERED, LONG_UNIT = 200_000, 200


@dataclass
class Pieces:
    """The pieces of a model; small and fixed, so each task gets a copy."""

    texts: list[str]
    scores: list[float]
    matched: list[bool]
    byte_ids: list[int]
    unknown: int

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Read by the driver; tasks never open the file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        if all(s <= 0 and s == int(s) for s, odd in zip(scores, special, strict=True) if not odd):  # merge order
            scores = [-math.log(2 - s) for s in scores]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(texts, scores, [not x for x in special], byte_ids, sp.unk_id())

    def bytes_of(self) -> list[bytes]:
        out = [t.replace(META, " ").encode() if m else b"" for t, m in zip(self.texts, self.matched, strict=True)]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        return out


class Encoder:
    """Built once per task."""

    def __init__(self, pieces: Pieces):
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        known = [(t.replace(META, " "), i) for i, t in enumerate(pieces.texts) if pieces.matched[i] and t]
        for text, i in known:
            self.automaton.add_word(text, (len(text), pieces.scores[i], i))
            if len(text) == 1:
                self.singles.add(text)
        self.automaton.make_automaton()
        self.sizes = {i: len(text) for text, i in known}
        self.byte_ids = pieces.byte_ids
        self.penalty = min((pieces.scores[i] for _, i in known), default=0.0) - 10
        self.divides = not any("\n" in t or re.search("[^ ] ", t) for t, _ in known)
        self.clear()

    def clear(self) -> None:
        #: units met since the last turn, and those of the turn before
        self.young: dict[str, array] = {}
        self.old: dict[str, array] = {}

    def of_pieces(self, unit: str) -> list[int]:
        """Ids of the best segmentation of ``unit``, each of whose characters is a piece."""
        n, sizes = len(unit), self.sizes
        best, piece = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for last, (size, score, i) in self.automaton.iter(unit):
            last += 1
            if (total := best[last - size] + score) > best[last]:
                best[last], piece[last] = total, i
        out, end = [], n
        while end:
            out.append(piece[end])
            end -= sizes[piece[end]]
        return out[::-1]

    def best(self, unit: str) -> list[int]:
        """Ids of the best segmentation of ``unit``, blanks standing for the meta symbol."""
        if self.singles.issuperset(unit):
            return self.of_pieces(unit)
        n, singles, penalty = len(unit), self.singles, self.penalty
        best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
        at = 0

        def skip(end: int) -> None:
            # positions up to end that are no piece of their own
            nonlocal at
            while at < end:
                if unit[at] not in singles and (score := best[at] + penalty) > best[at + 1]:
                    best[at + 1], back[at + 1] = score, (at, -1)
                at += 1

        for last, (size, score, i) in self.automaton.iter(unit):
            skip(last)
            if (total := best[last + 1 - size] + score) > best[last + 1]:
                best[last + 1], back[last + 1] = total, (last + 1 - size, i)
        skip(n)
        out, end = [], n
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in reversed(unit[start:end].encode())]
            end = start
        return out[::-1]

    def solve(self, unit: str) -> array:
        """Blanks are meta symbols here; the symbol itself goes by its bytes."""
        parts = array("i")
        for k, part in enumerate(unit.split(META)):
            if k:
                parts.extend(self.byte_ids[b] for b in META.encode())
            parts.extend(self.best(part))
        return parts

    def remembered(self, unit: str) -> array:
        """Pieces of a unit that was not met since the last turn; half of what is remembered is dropped a turn, the half not met."""
        ids = self.old.get(unit)
        if ids is None:
            ids = self.solve(unit)
        if len(unit) <= LONG_UNIT:
            self.young[unit] = ids
            if len(self.young) * 2 >= REMEMBERED:
                self.young, self.old = {}, self.young
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text
        if not self.divides:
            return np.asarray(self.solve(text), np.int32)
        out = array("i")
        for unit in UNIT.findall(text):
            out += self.young.get(unit) or self.remembered(unit)
        return np.asarray(out, np.int32)


def _list_array(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.fromiter((0 if r is None else len(r) for r in rows), np.int64, len(rows))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    full = [r for r in rows if r is not None and len(r)]
    values = pa.array(np.concatenate(full) if full else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows], pa.bool_()))


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``to``, which is replaced if there."""

    @arrow_udf("array<int>")
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(pieces)
        for batch in batches:
            yield _list_array([None if t is None else encoder.encode(t) for t in batch.to_pylist()])

    return docs.withColumn(to, of_text(text))


def decode(docs: DataFrame, pieces: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in ``to``; ids that make no UTF-8 give replacement characters."""

    @arrow_udf("string")
    def of_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces.bytes_of()
        for batch in batches:
            values, offsets = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            out: list[str | None] = []
            for i, there in enumerate(batch.is_valid().to_pylist()):
                if not there:
                    out.append(None)
                    continue
                text = b"".join(map(table.__getitem__, values[offsets[i] : offsets[i + 1]].tolist())).decode("utf-8", "replace")
                out.append(text[1:] if text[:1] == " " else text)
            yield pa.array(out, pa.string())

    return docs.withColumn(to, of_ids(ids))


def report(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Ids of every text, and whether they decode to it exactly."""
    both = decode(encode(docs.select("doc_id", "text"), pieces), pieces)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
