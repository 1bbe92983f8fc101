"""SentencePiece ids of texts and texts of ids, for models of the merge (BPE) type.

Method. A sequence of pieces is what the merges give exactly if each two neighbours are
compatible: merging the characters of the two together gives those two again. So a text is
encoded from left to right. An Aho-Corasick automaton names all pieces at each place; the
longest compatible one is taken, and where none fits the place is marked as failed in a
bitfield, the last piece is given back and the next shorter one is tried. A place fails once
at most, so the work stays linear. Pieces that merging their own characters does not give
are left out of the automaton. Compatibility is kept per pair.

No piece has a space mark after another character, or a character that stands in no longer
piece; a text is cut at such places, and the cut parts are encoded once while they are kept.

Size. Rows are independent: no shuffle. A task holds one Arrow batch, a bounded number of
known parts and pairs, and the matches of ``BLOCK`` places of a long part.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, text_of, texts

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Places of a long part whose matches are held at once.
BLOCK = 1 << 15
#: Most parts, and most pairs of pieces, a worker remembers, and the longest such part.
KNOWN, PAIRS, SHORT = 200_000, 400_000, 40
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL = 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one message in the wire format of model files."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", raw, at)[0], at + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class _Paged:
    """The rows of ``PieceModel._rows`` of a long text, made for ``BLOCK`` places at a time."""

    def __init__(self, model: PieceModel, text: str):
        self.model, self.text, self.held = model, text, {}

    def __getitem__(self, place: int) -> list[int]:
        block = place // BLOCK
        if block not in self.held:
            for old in [b for b in self.held if abs(b - block) > 1]:
                del self.held[old]
            low = block * BLOCK
            self.held[block] = self.model._rows(self.text, low, min(len(self.text), low + BLOCK))
        return self.held[block][place - block * BLOCK]


class PieceModel:
    """A model file: its pieces with scores, encoding and decoding of one text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        trainer, rules = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                self._add(one.get(1, b"").decode(), one.get(2, 0.0), one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != MERGE_MODEL:
            raise ValueError("not a model of the merge type")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with a character map, trimming or user symbols are not supported")
        self.prefix = bool(rules.get(3, 1))
        self.longest = max(map(len, self.score))
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
                         if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.raw = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)])
                    if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.matcher = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1 and self.merge(piece) == [piece]:
                self.matcher.add_word(piece, len(piece))
        self.matcher.make_automaton()
        self.cut = self._cut()

    def _add(self, piece: str, score: float, kind: int) -> None:
        if kind == NORMAL:
            self.score[piece], self.id_of[piece] = score, len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)

    def _cut(self) -> re.Pattern:
        """Pattern of the parts of a text that no piece crosses."""
        within = {c for p in self.score if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in within)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            return re.compile(f"[^{alone}]+|[{alone}]" if alone else r"(?s:.+)")
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """True if merging the characters of both gives both."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merge(left + right) == [left, right]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def _rows(self, text: str, low: int, high: int) -> list[list[int]]:
        """Lengths, shortest first, of the pieces that start at the places ``low`` to ``high``; a
        single character always counts."""
        rows = [[1] for _ in range(high - low)]
        for last, length in self.matcher.iter(text, low, min(len(text), high + self.longest)):
            start = last - length + 1
            if start < high:
                rows[start - low].append(length)
        return rows

    def split(self, text: str) -> list[str]:
        """Pieces of a normalised text by backtracking; a character without a piece is one."""
        size, pairs = len(text), self.pairs
        rows = self._rows(text, 0, size) if size <= BLOCK else _Paged(self, text)
        failed = bytearray((size >> 3) + 1)
        out: list[str] = []
        left: list[int] = []
        place, last = 0, None
        row = rows[0] if size else []
        k = len(row)
        while place < size:
            while k:
                k -= 1
                end = place + row[k]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[place:end]
                if last is not None:
                    fits = pairs.get((last, piece))
                    if not (self.compatible(last, piece) if fits is None else fits):
                        continue
                out.append(piece)
                left.append(k)
                place, last = end, piece
                if place < size:
                    row = rows[place]
                    k = len(row)
                break
            else:
                failed[place >> 3] |= 1 << (place & 7)
                if not out:
                    raise ValueError("no sequence of pieces fits")
                place -= len(out.pop())
                last = out[-1] if out else None
                row, k = rows[place], left.pop()
        return out

    def _ids(self, part: str) -> bytes:
        made: list[int] = []
        for piece in self.split(part):
            one = self.id_of.get(piece)
            if one is not None:
                made.append(one)
            elif self.bytes_of:
                made += [self.bytes_of[b] for b in piece.encode()]
            else:
                made.append(self.unknown)
        return np.array(made, "<i4").tobytes()

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        """Ids of a text, with the end id last."""
        plain = text.replace(" ", SPACE)
        if self.prefix and plain:
            plain = SPACE + plain
        known, made = self.known, []
        for part in self.cut.findall(plain):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or self._ids(part)
                if len(part) <= SHORT:
                    if len(known) >= KNOWN:
                        self.older, self.known = known, {}
                        known = self.known
                    known[part] = ids
            made.append(ids)
        if end:
            made.append(struct.pack("<i", self.end))
        return np.frombuffer(b"".join(made), "<i4")

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; bytes that are no valid UTF-8 become one U+FFFD each."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        joined = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text

    def _mended(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()

        def close() -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        del run[:size]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.raw[i]
            else:
                close()
                out.append(self.raw[i].decode())
        close()
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def public_model() -> str:
    """Path of the 32k model, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, end: bool = True, vocabulary: Callable[[], str] = public_model) -> DataFrame:
    """(doc_id, ids) of every whole text of ``docs`` (doc_id, text, any other columns).

    Null and empty texts have only the end id. Rows with a null or repeated doc_id stay.
    An empty table gives an empty one. ``vocabulary`` is called on the executor and names
    the model file there.
    """
    batches_of(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = model(vocabulary()).encode
            made = [encode(t.decode("utf-8", "replace"), end) for t in texts(batch, "text")]
            ends = np.cumsum([0, *map(len, made)])
            if ends[-1] < 1 << 31:
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(
                    [np.zeros(0, "<i4"), *made]), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
                continue
            for i, one in enumerate(made):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:i + 1], pa.array([one], pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, vocabulary: Callable[[], str] = public_model) -> DataFrame:
    """``encoded`` (ids, any other columns) with the text of its ids in ``decoded``.

    Null ids give a null text, an empty list an empty one. Ids outside the model are an
    error. A column already named decoded is replaced.
    """
    batches_of(encoded.sparkSession)
    plain = encoded.drop("decoded")
    names = plain.columns
    at = names.index("ids")
    inner = [f"c{i}" for i in range(len(names))]
    kinds = ", ".join(f"{i} {f.dataType.simpleString()}" for i, f in zip(inner, plain.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = model(vocabulary())
            ids = batch.column(at)
            made = [None if not row.is_valid else one.decode(row.values.to_numpy(zero_copy_only=False).tolist())
                    for row in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*inner, "decoded"])

    return plain.toDF(*inner).mapInArrow(run, f"{kinds}, decoded string").toDF(*names, "decoded")
