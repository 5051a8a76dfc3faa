"""Packing documents into token sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import array
import gc
import json
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table, text_or_empty
from tickloom.llm.registry import query

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

# Chunks of these characters (ASCII without apostrophe and "<", and the Latin-1 letters) split into runs of letters, single
# digits and runs of the rest under a pattern of the form "letters | one digit | other", whatever stands around them.
_LETTERS = "a-zß-öø-ÿ"
_SIMPLE = re.compile(rf"[A-ZÀ-ÖØ-Þ{_LETTERS}0-9!-&(-/:;=-@\[-`{{-~]+")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


_NATIVE = sys.byteorder == "little" and array.array("I").itemsize == 4


def _byte_letters() -> list[str]:
    """The printable character byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembered by blank-separated chunk.

    A tokenizer that drops white space, lower-cases and splits as the pattern above treats each chunk on its own, so equal chunks are
    encoded once; chunks of simple characters go straight to the tokenizer's model, all others through the whole tokenizer.
    Any other tokenizer encodes whole texts. The memory is emptied beyond ``limit`` chunks.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = json.dumps((spec.get("pre_tokenizer") or {}))
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splits and '"behavior": "Removed"' in splits
        self.letters = _byte_letters()
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            found = self.words[word] = _le([x.id for x in self.tokenizer.model.tokenize(shown)])
        return found

    def _chunk(self, chunk: str) -> bytes:
        if _SIMPLE.fullmatch(chunk):
            found = b"".join([self._word(w) for w in _PARTS.findall(chunk.lower())])
        else:
            found = _le(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return _le(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.chunks) > self.limit:
            self.chunks, self.words = {"": b""}, {}
        get = self.chunks.get
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(get, chunks))
        if None in found:
            found = [f if f is not None else get(c) or self._chunk(c) for c, f in zip(chunks, found)]
        return b"".join(found)


def _le(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if _NATIVE else np.asarray(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker: it lives as long as the worker does."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        gc.freeze()
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, closed by ``end_id``, into pieces of at most ``capacity``.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (array). Null and empty texts
    give the one id that closes them; an empty table gives no rows; rows that share a doc_id stay separate documents.
    """
    last = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        gc.disable()  # nothing here forms cycles, and the memory of chunks is long to walk
        for frame in batches:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = encoder.encode(text) + last
                for a in range(0, len(ids), step):
                    part = ids[a: a + step]
                    row = (doc_id, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64"})
        gc.enable()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item: the first bin with room, items from the largest.

    A tournament tree holds the most room below every node, so the first fit takes one walk from the root.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i] = node - leaves
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 4096) -> DataFrame:
    """Give every piece a sequence and its offset there.

    Pieces fall into groups of about ``group_pieces`` by a hash, each packed on its own: no group grows with the table, and the
    waste of a group's last bins is below a sequence in a few hundred. Adds ``sequence_id`` and ``offset`` (gapless from 0).
    """
    pieces = staged(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins = np.asarray(first_fit_decreasing(frame["length"].tolist(), capacity), np.int64)
        length = frame["length"].to_numpy()
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(length[order]) - length[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
        offset = np.empty(len(frame), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        return frame.drop(columns="__group").assign(sequence_id=frame["__group"].to_numpy().astype(np.int64) * 2**32 + bins, offset=offset)

    names = [f.simpleString().replace(":", " ", 1) for f in pieces.schema]
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("__group").applyInPandas(fill, ", ".join([*names, "sequence_id long", "offset long"]))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), word_tokenizer()))
