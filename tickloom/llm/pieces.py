"""Merge-type piece encoding by backtracking over longest matches, and its decoding."""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, text_or_empty
from tickloom.llm.registry import query

#: Stands for a blank inside pieces.
SPACE = "▁"
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What an unknown id decodes to.
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at: at + size]
        at += size


def _one_each(error: UnicodeError):
    """A replacement character for every byte that is no part of a character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("tickloom-each", _one_each)


class PieceModel:
    """Encodes and decodes with the merge-type (BPE) model in a file, byte pieces standing in for characters it lacks.

    Merging joins, again and again, the two neighbours whose joint piece scores best, the leftmost of equals. ``encode`` finds
    its result without simulating it: a row of pieces is that result exactly if merging the text of any two neighbours gives
    back these two. So it takes the longest piece at a position (all matches come from one Aho-Corasick scan), checks it
    against its neighbour by merging the two anew, falls back to shorter pieces, and steps back where none fits; positions
    that led nowhere are marked in a bitfield and not entered again, which keeps the search linear.

    Merging never crosses two neighbours that stand side by side in no piece, so a text is cut there and each part encoded on its own. Where
    no piece has a blank after another character, texts are first cut into chunks at their blanks. Chunks, parts and checked pairs are remembered up
    to ``limit`` of each. Models with other normalisation than none, without
    byte pieces, of another type or with user-defined or unused pieces are refused.
    """

    def __init__(self, path: str, limit: int = 300_000):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece.get(1, b"").decode())
                    scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    self.kinds.append(piece.get(3, NORMAL))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normal = dict(_fields(value))
        plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
        if trainer.get(3) != 2 or trainer.get(24) or not trainer.get(35) or not plain or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte pieces and without normalisation are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        # Byte pieces are named <0x00> to <0xFF>.
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.packed = {p: struct.pack("<i", i) for p, i in self.ids.items()}
        # Neighbours inside a piece; merging never crosses any others.
        self.inside = frozenset(p[i: i + 2] for p in self.ids for i in range(len(p) - 1))
        # Pieces that merging never reaches are no matches.
        reached = [p for p in self.ids if self.merge(p) == [p]]
        self.found = ahocorasick.Automaton()
        for p in reached:
            self.found.add_word(p, len(p))
        self.found.make_automaton()
        known = set(reached)
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in known), 1) for p in reached}
        self.by_chunk = not any(pair[1] == SPACE != pair[0] for pair in self.inside)
        self.limit = limit
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return (UNKNOWN_TEXT if self.kinds[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ")).encode()

    def merge(self, text: str, border: int = 0) -> list[str]:
        """Merging as defined, for short texts; stops early, with what it has, when a merge spans the position ``border``."""
        parts = list(text)
        get, least = self.score.get, -float("inf")
        gain = [get(j, least) for j in map(str.__add__, parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == least:
                break
            at = gain.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at: at + 2] = [joined]
            del gain[at]
            if at < len(gain):
                gain[at] = get(joined + parts[at + 1], least)
            if at:
                gain[at - 1] = get(parts[at - 1] + joined, least)
            if border and sum(map(len, parts[:at])) < border < sum(map(len, parts[: at + 1])):
                break
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Does merging the text of two pieces give back these two?"""
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        known = self.pairs[before, piece] = self.merge(before + piece, len(before)) == [before, piece]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of a text; a character that is no piece stays alone."""
        n = len(text)
        longest = [1] * n
        for end, size in self.found.iter(text):  # by rising end, so a start's longest match comes last
            longest[end - size + 1] = size
        dead: bytearray | None = None
        out: list[str] = []
        pairs, shorter = self.pairs, self.shorter
        at, size, before = 0, longest[0], ""
        while True:
            end = at + size
            piece = text[at:end]
            if dead is None or not dead[end >> 3] & (1 << (end & 7)):
                fits = pairs.get((before, piece)) if before else True
                if fits is None:
                    fits = self.fits(before, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    at, size, before = end, longest[end], piece
                    continue
            if size > 1:
                size = shorter[piece]
                continue
            # Nothing fits here: the piece before ends at a dead position and has to become shorter.
            if dead is None:
                dead = bytearray((n >> 3) + 1)
            dead[at >> 3] |= 1 << (at & 7)
            size = len(out.pop())
            at -= size
            before = out[-1] if out else ""

    def _bytes(self, part: str) -> bytes:
        """Ids of a part that is one piece, or of the bytes of a character that is none."""
        known = self.packed.get(part)
        return b"".join([struct.pack("<i", self.byte_ids[b]) for b in part.encode("utf-8", "replace")]) if known is None else known

    def _chunk(self, chunk: str) -> bytes:
        text = SPACE + chunk
        cuts = [i for i, pair in enumerate(map(str.__add__, text, chunk), 1) if pair not in self.inside]
        found = b""
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            part = text[a:b]
            known = self.parts.get(part)
            if known is None:
                known = b"".join(map(self._bytes, self.split(part)))
                if b - a < 100:
                    self.parts[part] = known
            found += known
        if len(chunk) < 100:
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers; the empty text has none."""
        if not text:
            return b""
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        if len(self.parts) > self.limit:
            self.parts.clear()
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_chunk:
            chunks = [text[1:]]
        elif SPACE + SPACE in text:
            chunks = [c[1:] for c in re.findall(f"{SPACE}+[^{SPACE}]*", text)]
        else:
            chunks = text.split(SPACE)[1:]
        found = list(map(self.chunks.get, chunks))
        if None in found:
            found = [f if f is not None else self.chunks.get(c) or self._chunk(c) for c, f in zip(chunks, found)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, the blank that encoding puts in front taken off."""
        text = b"".join(map(self.surface.__getitem__, ids))
        for i in ids:
            if self.surface[i]:
                if self.kinds[i] == NORMAL and self.pieces[i][0] == SPACE:
                    text = text[1:]
                break
        return text.decode("utf-8", "tickloom-each")


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    """One for each Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """Ids of every whole text: ``doc_id, ids`` (array) and, if asked for, ``decoded``, the text that these ids decode to.

    No begin or end ids, no sampling. Null and empty texts have no ids and decode to the empty text; rows that share a doc_id or have none
    stay separate rows; an empty table gives none; columns other than ``doc_id`` and ``text`` are not read. One pass without
    a shuffle: a long text is cut into chunks, so time and memory follow its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            encoded = [pieces.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
            flat = np.frombuffer(b"".join(encoded), "<i4")
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                columns.append(pa.array([pieces.decode(np.frombuffer(e, "<i4").tolist()) for e in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids``; a null or empty list decodes to the empty text, a null id or one the model lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_texts(table(spark, sf_dir, "documents"), piece_model(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
