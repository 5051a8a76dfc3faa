"""Phrase collocations by partitioned mining: shards at lowered support, then one exact count of all that any shard found."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table
from tickloom.llm.registry import query
from tickloom.llm.shingles import mix

C = F.col
#: Shards a language is cut into, bits of a filter (a power of two), and words a task counts at a time, by hashes and by the words themselves.
SHARDS, FILTER_BITS, HASHED_WORDS, EXACT_WORDS = 8, 2**26, 2_000_000, 1_000_000
# The characters that end a piece, all replaced by the first, which then stands alone as a word.
STOPS = [b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"]
_SLICE = 1 << 22
#: Bits of a phrase's hash, few enough to keep shuffled rows small, and the first of the bits that a filter looks at second.
HASH_BITS, SECOND = 48, 22
_LOW = np.uint64(2**HASH_BITS - 1)
#: Phrases a task remembers the counts of.
HELD = 400_000


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z in lower case, with ``b"."`` wherever a piece ends; long texts come in slices cut at blanks."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= _SLICE else text.find(b" ", at + _SLICE)
        part = text[at: end if end >= 0 else len(text)].lower()
        for stop in STOPS:
            part = part.replace(stop, b" . ")
        yield part.split()
        at = end if end >= 0 else len(text)


class _Codes(dict):
    """32-bit code of every word seen, 0 for the end of a piece; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = 0 if word == b"." else xxhash.xxh32_intdigest(word) or 1
        self[word] = code
        return code


class _Serial(dict):
    """Number of every word seen, with the words and their codes by number."""

    def __init__(self):
        self.words: list[bytes] = []
        self.codes = array("I")

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        self.codes.append(0 if word == b"." else xxhash.xxh32_intdigest(word) or 1)
        return at


class _Filter:
    """Bits of a set of 64-bit keys: every key of the set is found, few others are. Its size is fixed."""

    def __init__(self, keys: DataFrame):
        """``keys``: one long column ``key``; the bits are combined by Spark, at most ``FILTER_BITS / 64`` rows reach the driver."""
        mask = FILTER_BITS - 1
        bit = F.explode(F.array(C("key").bitwiseAND(mask), F.shiftrightunsigned("key", SECOND).bitwiseAND(mask))).alias("bit")
        one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
        rows = keys.select(bit).groupBy(F.shiftright("bit", 6).cast("int").alias("slot")).agg(F.bit_or(one).alias("bits")).toPandas()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bits = self.shared.value
        mask = np.uint64(64 * len(bits) - 1)
        a, b = keys & mask, keys >> np.uint64(SECOND) & mask
        six, low = np.uint64(6), np.uint64(63)
        return (bits[a >> six] >> (a & low) & bits[b >> six] >> (b & low) & np.uint64(1)).astype(bool)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in batches:
        rows, sizes = [], []
        for text in batch.column("text").to_pylist():
            parts = [np.fromiter(map(codes.__getitem__, w), np.uint32, len(w)) for w in _words(text)]
            all_ = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            rows.append(all_.tobytes())
            sizes.append(int(np.count_nonzero(all_)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("part"), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=["lang", "part", "n_words", "codes"])


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of many documents, each closed by a 0, with the document's language seed and part at every position."""
    codes: list[np.ndarray] = []
    seeds: list[int] = []
    parts: list[int] = []

    def flush():
        sizes = [len(c) for c in codes]
        return (np.concatenate(codes).astype(np.uint64), np.repeat(np.asarray(seeds, np.int64).view(np.uint64), sizes),
                np.repeat(np.asarray(parts, np.int64).view(np.uint64), sizes))

    held = 0
    for batch in batches:
        for seed, part, packed in zip(batch.column("seed").to_pylist(), batch.column("part").to_pylist(), batch.column("codes").to_pylist()):
            codes.append(np.append(np.frombuffer(packed, np.uint32), np.uint32(0)))
            seeds.append(seed)
            parts.append(part)
            held += len(codes[-1])
            if held >= HASHED_WORDS:
                yield flush()
                codes, seeds, parts, held = [], [], [], 0
    if codes:
        yield flush()


def _start(codes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of single words in their languages."""
    return mix(codes ^ seed) & _LOW


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of the phrases ``h`` with the next word each."""
    return mix(h[:-1] + (codes << np.uint64(16))) & _LOW


def _counter(size: int, known: _Filter | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the runs of ``size`` words in a part, both of whose runs of one word less are ``known``: ``h, part, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, seed, part in _buffers(batches):
            h, live = _start(codes, seed), codes != 0
            for j in range(1, max(size - 1, 1)):
                h, live = _longer(h, codes[j:]), live[:-1] & (codes[j:] != 0)
            if known is not None:
                keys = h if size == 2 else h ^ part[: len(h)]
                live = live & known(keys)
                h, live = _longer(h, codes[size - 1:]), live[:-1] & live[1:]
            at = np.flatnonzero(live)
            own = part[at] if size > 1 else np.zeros(len(at), np.uint64)
            _, first, n = np.unique(h[at] ^ own, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at][first].view(np.int64)), pa.array(own[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "part", "n"])

    return run


def _paired(known: _Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the words of pairs that are ``known``, once a buffer: ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, seed, _ in _buffers(batches):
            h, live = _start(codes, seed), codes != 0
            met = live[:-1] & live[1:] & known(_longer(h, codes[1:]))
            own = np.zeros(len(h), bool)
            own[:-1] |= met
            own[1:] |= met
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[own]).view(np.int64))], names=["key"])

    return run


def _exact(words_known: _Filter, phrases_known: _Filter, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of known words and phrases, told apart by their words: ``lang, words, phrase, n``."""

    def flush(serial: _Serial, ids: np.ndarray, seed: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[bytes], np.ndarray]]:
        codes = np.frombuffer(serial.codes, np.uint32).astype(np.uint64)[ids]
        h, live = _start(codes, seed), codes != 0
        for size in range(1, longest + 1):
            if size > 1:
                h, live = _longer(h, codes[size - 1:]), live[:-1] & (codes[size - 1:] != 0)
            at = np.flatnonzero(live & (words_known if size == 1 else phrases_known)(h))
            while len(at):
                _, first, group = np.unique(h[at], return_index=True, return_inverse=True)
                rep = at[first]
                # Equal hashes of other words or languages wait for the next round.
                same = seed[at] == seed[rep[group]]
                for j in range(size):
                    same &= ids[at + j] == ids[rep[group] + j]
                text = [b" ".join([serial.words[i] for i in ids[r: r + size].tolist()]) for r in rep.tolist()]
                yield seed[rep], size, text, np.bincount(group[same], minlength=len(rep))
                at = at[~same]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, ids, seeds, sizes, names, held = _Serial(), [], [], [], {}, 0
        counts: Counter[tuple[int, int, bytes]] = Counter()

        def count():
            nonlocal serial
            seed = np.repeat(np.asarray(seeds, np.int64).view(np.uint64), sizes)
            for own, size, text, n in flush(serial, np.concatenate(ids), seed):
                for key, more in zip(zip(own.view(np.int64).tolist(), [size] * len(text), text), n.tolist()):
                    counts[key] += more
            if len(serial) > 300_000:
                serial = _Serial()

        def out():
            for part in batched(counts.items(), 50_000):
                keys, n = zip(*part)
                own, size, text = zip(*keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[s] for s in own], pa.string()), pa.array(size, pa.int32()), pa.array(text, pa.binary()), pa.array(n, pa.int64())],
                    names=["lang", "words", "phrase", "n"])
            counts.clear()

        for batch in batches:
            for lang, seed, text in zip(batch.column("lang").to_pylist(), batch.column("seed").to_pylist(), batch.column("text").to_pylist()):
                names[seed] = lang
                parts = [np.fromiter(map(serial.__getitem__, w), np.int64, len(w)) for w in _words(text)]
                ids.append(np.concatenate([*parts, [serial[b"."]]]))
                seeds.append(seed)
                sizes.append(len(ids[-1]))
                held += sizes[-1]
                if held >= EXACT_WORDS:
                    count()
                    ids, seeds, sizes, held = [], [], [], 0
                    if len(counts) > HELD:
                        yield from out()
        if ids:
            count()
        yield from out()

    return run


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``lang, phrase, words, a`` of all runs of 2 to ``longest`` words that a language holds ``support`` times and of the words in them, and ``lang, n`` of all words.

    A language's documents fall into ``shards`` by the partitions they are read in, and a phrase with ``support`` occurrences has, in some shard, at least the
    share of ``support`` that the shard has of the language's words. So every shard is mined for the phrases that reach that lowered
    support: by length, each phrase only where both its parts of one word less reached it. A phrase goes if even the most that the
    other shards may have missed does not lift it to ``support``, and a pair if the counts of all shards do not. The union of what shards found is counted over all texts, by the words themselves, and what reaches ``support`` stays.

    A shard is a label that is written once with the coded words, not a task: it spreads over as many tasks as its partitions fill. These
    count hashes of a bounded buffer each, and Spark sums them by (hash, shard).
    Sets of hashes reach the tasks as filters of fixed size; their false hits and hash collisions cost counting and change no result.
    """
    base = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(C("text").cast("binary"), F.lit(b"")).alias("text"),
                       (F.spark_partition_id() % shards).alias("shard"))
    base = base.withColumn("part", F.xxhash64("lang", "shard")).drop("shard")
    coded = base.mapInArrow(_coded, "lang string, part long, n_words long, codes binary")
    coded = staged(coded, "phrase-codes", compression="zstd")
    sizes = staged(coded.groupBy("lang", "part").agg(F.sum("n_words").alias("w")), "shard-words")
    whole = sizes.groupBy("lang").agg(F.sum("w").alias("n"))
    # The smallest whole number that is at least support * w / n.
    need = sizes.join(whole, "lang").withColumn("need", F.expr(f"(cast({support} as decimal(20,0)) * w + n - 1) div greatest(n, 1)"))
    # What all shards of a language can hold of a phrase without finding it.
    hidden = need.groupBy("lang").agg(F.sum(C("need") - 1).alias("hidden"))
    need = staged(need.join(hidden, "lang").select("part", "need", "hidden"), "shard-support")

    rows = coded.select(F.xxhash64("lang").alias("seed"), "part", "codes")
    counted = rows.mapInArrow(_counter(1, None), "h long, part long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words_known = known = _Filter(counted.where(C("n") >= support).select(C("h").alias("key")))
    levels = []
    for size in range(2, longest + 1):
        dealt = rows.mapInArrow(_counter(size, known), "h long, part long, n long")
        if size == 2:
            # Every shard counts all pairs of frequent words: their sum is known, and what does not reach the whole support goes.
            dealt = dealt.repartition("h")
            enough = dealt.groupBy("h").agg(F.sum("n").alias("n")).where(C("n") >= support).select("h")
        counted = dealt.groupBy("h", "part").agg(F.sum("n").alias("n"))
        local = counted.join(need, "part").where(C("n") >= C("need")).select("h", "part", (C("n") - C("need") + 1).alias("over"), "hidden")
        if size == 2:
            local = local.join(enough, "h", "left_semi")
        # Shards that did not find a longer phrase hold less than their support of it: what cannot reach the whole support goes.
        bound = F.sum("over").over(Window.partitionBy("h")) + C("hidden")
        level = staged(local.withColumn("bound", bound).where(C("bound") >= support).select("h", "part"), "shard-phrases")
        levels.append(level.select(C("h").alias("key")))
        if size < longest:
            known = _Filter(level.select(C("h").bitwiseXOR(C("part")).alias("key")))
    if levels:  # a word is a part of a phrase only if it is in a frequent pair
        words_known = _Filter(rows.mapInArrow(_paired(_Filter(levels[0])), "key long").distinct())
    union = levels[0] if levels else coded.select(C("n_words").alias("key")).limit(0)
    for level in levels[1:]:
        union = union.unionByName(level)
    texts = base.select("lang", F.xxhash64("lang").alias("seed"), "text")
    exact = texts.mapInArrow(_exact(words_known, _Filter(union), longest), "lang string, words int, phrase binary, n long")
    exact = exact.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("a")).where(C("a") >= support)
    return staged(exact.select("lang", C("phrase").cast("string").alias("phrase"), "words", "a"), "phrases"), whole


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of every language by how much more often their words meet than by chance: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``longest`` words that a language holds ``a >= support`` times is cut after each of its first words into parts
    of ``l`` and ``r`` occurrences; its score is the least ``floor(1000 * a * n / (l * r))`` of its cuts, in whole numbers of up to 38 digits, the first
    such cut counts. Phrases inside a longer phrase of as many occurrences go. Order: score, then ``a``, falling, then the phrase by its UTF-8 bytes.

    Words are runs of anything but space and tab, A-Z in lower case; pieces end at ``.,;:!?`` and line ends. A null language is
    ``und``, null and empty texts have no words, repeated rows and rows without doc_id count like any other, an empty table gives no rows;
    columns other than ``doc_id, text, lang`` are not read. Texts of any length are read in slices.
    """
    phrases, whole = frequent_phrases(docs, support, longest, shards)
    many = phrases.where(C("words") >= 2)
    head = F.expr("substring_index(phrase, ' ', k)")
    cuts = many.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), C("words") - 1)).alias("k")).withColumn("head", head)
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    first = phrases.select("lang", C("phrase").alias("head"), C("a").alias("l"))
    second = phrases.select("lang", C("phrase").alias("rest"), C("a").alias("r"))
    cuts = cuts.join(first, ["lang", "head"]).join(second, ["lang", "rest"]).join(whole, "lang")
    big = {c: f"cast({c} as decimal(16,0))" for c in "anlr"}
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {big['a']} * {big['n']}) div ({big['l']} * {big['r']})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), j -> transform(sequence(1, words - j + 1), i -> array_join(slice(split(phrase, ' '), i, j), ' '))))")
    inside = phrases.where(C("words") >= 3).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(C("outer").isNull() | (C("outer") < C("a")))
    left = left.select("lang", "phrase", "a", C("cut.l").alias("l"), C("cut.r").alias("r"), "n", C("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(C("rank") <= top)
    return ranked.select("lang", C("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_PHRASES_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score, j FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.a >= b.a AND len(f.phrase) > len(b.phrase) AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= 2000
"""


@query("op11_collocations", _PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
