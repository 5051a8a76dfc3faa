"""Line de-duplication across documents: range-partitioned hashes, streamed runs, keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BLANKS, ascii_lower, parallelism, staged, table, text_or_empty
from tickloom.llm.registry import query

_SORTED = "h1 long, h2 int, doc long, tag long, pos int, pid int, docs long, last_doc long, open boolean"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream sorted occurrences and give every one its run's documents and last document.

    The rows come by (h1, h2, doc), so a run's distinct documents are counted by looking at the row before, and its last
    row holds its last document. A run is written when it ends. The first and the last run of a partition may go on in its
    neighbours: their rows leave at once, marked ``open``, and carry the counts of their own partition in one summary row
    (``pos`` -1). So memory is one Arrow batch plus one inner run, and an inner run is never larger than its partition.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    held: list[pd.DataFrame] = []
    first_done = False

    def flush(last: bool) -> pd.DataFrame | None:
        nonlocal held, first_done
        if not held:
            return None
        run = pd.concat(held, ignore_index=True)
        held = []
        doc = run["doc"].to_numpy()
        docs = 1 + int((doc[1:] != doc[:-1]).sum())
        run["pid"], run["docs"], run["last_doc"], run["open"] = pid, docs, doc[-1], last or not first_done
        if last or not first_done:
            run = pd.concat([run, run.iloc[:1].assign(pos=-1)], ignore_index=True)
        first_done = True
        return run

    for frame in batches:
        if frame.empty:
            continue
        h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
        cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(frame)]
        if held and (held[-1]["h1"].iloc[-1] != h1[0] or held[-1]["h2"].iloc[-1] != h2[0]):
            yield flush(False)
        held.append(frame.iloc[: ends[0]])
        if len(starts) == 1:
            continue
        yield flush(False)
        if len(starts) > 2:  # whole runs inside the batch, all at once
            inner = frame.iloc[starts[1]: ends[-2]].copy()
            s, e = starts[1:-1] - starts[1], ends[1:-1] - starts[1]
            doc = inner["doc"].to_numpy()
            new = np.r_[1, (doc[1:] != doc[:-1]).astype(np.int64)]
            new[s] = 1
            docs = np.add.reduceat(new, s)
            inner["pid"], inner["docs"], inner["last_doc"], inner["open"] = pid, np.repeat(docs, e - s), np.repeat(doc[e - 1], e - s), False
            yield inner
        held.append(frame.iloc[starts[-1]:])
    if held:
        yield flush(True)


def _bitmap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        maps = []
        for n, dropped in zip(frame["n_lines"], frame["dropped"]):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(dropped, np.int64)] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "tag": frame["tag"], "n_lines": frame["n_lines"], "n_dropped": [len(x) for x in frame["dropped"]], "keep": maps})


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = []
        for text, keep in zip(frame["__text"], frame["__keep"]):
            if keep is not None:
                parts = text.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(parts))
                text = "\n".join(p for p, b in zip(parts, bits) if b)
            texts.append(text)
        yield frame.drop(columns=["__keep"]).assign(__text=texts)


def _line_key(line):
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _tag(text):
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(text, F.length(text))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines stay: ``doc_id, tag, n_lines, n_dropped, keep`` for each document that loses any.

    A line's key is the line stripped of ASCII blanks, A-Z in lower case. A key of at least ``min_chars`` code points in at
    least ``min_docs`` documents keeps only the lines of the largest doc_id that has it. ``keep`` is a zlib-compressed
    bitmap, a bit a line (1: stays). Keys are compared by 96 bits of two hashes.

    Occurrences (hash, document, position) are written once, range-partitioned by (hash, document), sorted within and
    streamed: a line that a third of all documents share spreads over as many partitions as its rows fill, and its counts
    meet through two summary rows a partition. Null doc_ids count as one document smaller than all others; rows that share
    a doc_id are one document; null or empty texts have one line, too short to go; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    lines = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), _tag(text).alias("tag"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "tag", "pos", _line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = staged(lines.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "tag", "pos"), "lines")
    parts = parallelism(spark)
    runs = lines.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc").mapInPandas(_runs, _SORTED)
    # Inner runs are decided; open ones wait for what their neighbours know of them.
    runs = staged(runs.where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("last_doc")) | F.col("open")), "runs")
    ends = runs.where(F.col("open") & (F.col("pos") < 0)).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("last_doc").alias("all_last"))
    waiting = runs.where(F.col("open") & (F.col("pos") >= 0)).select("h1", "h2", "doc", "tag", "pos").join(F.broadcast(ends), ["h1", "h2"])
    decided = runs.where(~F.col("open")).select("doc", "tag", "pos").unionByName(
        waiting.where((F.col("all_docs") >= min_docs) & (F.col("doc") != F.col("all_last"))).select("doc", "tag", "pos"))
    # Repeated rows give repeated positions.
    dropped = decided.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    counts = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), _tag(text).alias("tag"), F.size(F.split(text, "\n")).alias("n_lines"))
    dropped = dropped.join(counts.groupBy("doc", "tag").agg(F.first("n_lines").alias("n_lines")), ["doc", "tag"])
    named = dropped.select(F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"), "tag", "n_lines", "dropped")
    return named.mapInPandas(_bitmap, "doc_id long, tag long, n_lines int, n_dropped int, keep binary")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, dropped: str | None = None) -> DataFrame:
    """The rows of ``docs`` with the lines left that their bitmaps keep; other columns stay.

    ``dropped`` names a column to add: how many lines the row lost; a column of that name is replaced. A null text becomes empty.
    """
    held = [c for c in docs.columns if c != "text"]
    left = docs.select(F.struct(*held).alias("__row"), text_or_empty().alias("__text"), F.col("doc_id").alias("__id"))
    left = left.withColumn("__tag", _tag(F.col("__text")))
    right = bitmaps.select(F.col("doc_id").alias("__id2"), F.col("tag").alias("__tag2"), F.col("keep").alias("__keep"), F.col("n_dropped").cast("long").alias("__dropped"))
    both = left.join(right, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__tag") == F.col("__tag2")), "left").select("__row", "__text", F.coalesce("__dropped", F.lit(0)).alias("__dropped"), "__keep")
    schema = both.drop("__keep").schema
    out = both.where(F.col("__keep").isNull()).drop("__keep").unionByName(both.where(F.col("__keep").isNotNull()).mapInPandas(_apply, schema))
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != dropped], *([F.col("__dropped").alias(dropped)] if dropped else []))


_LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op9_line_dedup", _LINES_SQL)
def line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = staged(line_bitmaps(docs), "bitmaps")
    docs = docs.withColumn("n_lines", F.size(F.split(text_or_empty(), "\n")).cast("long"))
    kept = drop_lines(docs, bitmaps, dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
