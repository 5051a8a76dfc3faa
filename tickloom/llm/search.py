"""Exact top-k search by BM25: inverted index in shards, block-max WAND pruning, exact merge with global statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table, text_or_empty
from tickloom.llm.registry import query
from tickloom.llm.shingles import _words as word_hashes

C = F.col
K1, B = 1.2, 0.75
#: Documents and postings of an index shard, documents of a block, and terms of a block of queries, at most.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, QUERY_TERMS = 4096, 1_000_000, 16, 500_000
#: A term of a shard is common if one document in ``COMMON`` has it; the most frequent ``COMMON_TERMS`` are a matrix, for ``TOGETHER`` queries at a time.
COMMON, COMMON_TERMS, TOGETHER = 16, 2048, 64
#: What bounds in single precision are raised by.
SLACK = np.float32(1.001)

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_INDEX = "docs binary, lengths binary, terms binary, starts binary, doc binary, tf binary"


def _term_counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the distinct words (A-Z in lower case), sorted, their counts, and the number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    counts = Counter(words)
    terms = np.fromiter(map(word_hashes.__getitem__, counts), np.uint64, len(counts))
    order = np.argsort(terms)
    return terms[order], np.fromiter(counts.values(), np.int64, len(counts))[order], len(words)


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: list[int] = []
    parts: list[tuple[np.ndarray, np.ndarray, int]] = []
    postings = 0

    def shard() -> pd.DataFrame:
        lengths = np.array([n for _, _, n in parts], np.int64)
        doc = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(t) for t, _, _ in parts])
        term, tf = np.concatenate([t for t, _, _ in parts]), np.concatenate([c for _, c, _ in parts]).astype(np.uint32)
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term = term[order]
        terms, starts = np.unique(term, return_index=True)
        row = (np.array(ids, np.int64), lengths, terms, starts.astype(np.int64), doc[order], tf[order])
        return pd.DataFrame([[x.tobytes() for x in row]], columns=["docs", "lengths", "terms", "starts", "doc", "tf"])

    for frame in batches:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            ids.append(doc_id)
            parts.append(_term_counts(text))
            postings += len(parts[-1][0])
            if len(ids) == SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard()
                ids, parts, postings = [], [], 0
    if ids:
        yield shard()
    word_hashes.clear()  # the worker lives on


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard: its documents and their lengths, sorted term hashes, and postings (document, count) by term."""
    rows = docs.where(C("doc_id").isNotNull()).select(C("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return staged(rows.mapInPandas(_build, _INDEX), "index")


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for terms, starts, doc in zip(frame["terms"], frame["starts"], frame["doc"]):
            starts = np.frombuffer(starts, np.int64)
            yield pd.DataFrame({"term": np.frombuffer(terms, np.int64), "df": np.diff(np.r_[starts, len(doc) // 2])})


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Shard:
    """Postings of a shard with BM25 impacts, by term and by document, and its common terms as a matrix with the largest impact of each in every block."""

    def __init__(self, row, mean_length: float):
        self.docs, lengths = np.frombuffer(row.docs, np.int64), np.frombuffer(row.lengths, np.int64)
        self.terms, doc = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.doc, np.uint16)
        self.starts, tf = np.frombuffer(row.starts, np.int64), np.frombuffer(row.tf, np.uint32).astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / max(mean_length, 1e-9)))[doc])
        del tf
        self.doc = doc.astype(np.int64)
        self.count = np.diff(np.r_[self.starts, len(doc)])
        order = np.argsort(doc, kind="stable")  # terms stay in order within a document
        self.own_term, self.own_impact = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)[order], self.impact[order]
        self.own_count = np.bincount(doc, minlength=len(self.docs))
        self.own_start = np.cumsum(self.own_count) - self.own_count
        self.blocks = -(-len(self.docs) // BLOCK)
        common = np.flatnonzero(self.count * COMMON >= len(self.docs))
        common = common[np.argsort(-self.count[common], kind="stable")[:COMMON_TERMS]]
        self.place = np.full(len(self.count), -1)
        self.place[common] = np.arange(len(common))
        at = _ranges(self.starts[common], self.count[common])
        self.matrix = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.matrix[self.doc[at], np.repeat(np.arange(len(common)), self.count[common])] = self.impact[at]
        self.block_max = self.matrix.reshape(self.blocks, BLOCK, -1).max(1)
        self.weight = np.zeros(len(self.count))

    def search(self, asked: list[tuple[np.ndarray, np.ndarray]], best: list[list[tuple[float, int]]], k: int) -> None:
        """Update ``best`` ((-score, doc_id), sorted, one list a query) with this shard's documents for the queries (``term, idf``).

        The postings of a query's rare terms are summed; its common ones count by their largest impacts in a block at first (block-max
        WAND). Only blocks where that reaches the bar, the k-th best score, of one of the queries are estimated, by one product with
        the matrix, and only documents whose estimate reaches the bar are scored. Bounds and estimates are in single precision and
        raised by ``SLACK``, far above its error; scores are summed in double precision in the order of the terms.
        """
        n, m = len(asked), self.blocks * BLOCK
        sizes = np.array([len(t) for t, _ in asked])
        term, idf, query = np.concatenate([t for t, _ in asked]), np.concatenate([w for _, w in asked]), np.repeat(np.arange(n), sizes)
        place = self.place[term]
        weights = np.zeros((n, self.matrix.shape[1]), np.float32)
        often = place >= 0
        weights[query[often], place[often]] = idf[often]
        term, idf, query = term[~often], idf[~often], query[~often]
        counts = self.count[term]
        at = _ranges(self.starts[term], counts)
        rare = np.bincount(np.repeat(query * m, counts) + self.doc[at], self.impact[at] * np.repeat(idf, counts), n * m).reshape(n, m)
        bars = np.array([-b[-1][0] * (1 - 1e-9) if len(b) == k else 1e-300 for b in best])
        bound = rare.reshape(n, self.blocks, BLOCK).max(2) + weights @ self.block_max.T * SLACK
        reached = bound >= bars[:, None]
        some, blocks = np.flatnonzero(reached.any(1)), np.flatnonzero(reached.any(0))
        if not len(some):
            return
        rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        estimate = rare[np.ix_(some, rows)] + weights[some] @ self.matrix[rows].T * SLACK
        for i, own in zip(some.tolist(), estimate):
            near = np.flatnonzero(own >= bars[i])
            if len(near) > 2 * k:  # the most promising first, the others if they reach the bar these set
                first = near[np.argpartition(own[near], len(near) - k)[len(near) - k:]]
                best[i] = self._scored(rows[first], *asked[i], best[i], k)
                bar = -best[i][-1][0] * (1 - 1e-9) if len(best[i]) == k else 1e-300
                own[first] = -1
                near = np.flatnonzero(own >= bar)
            if len(near):
                best[i] = self._scored(rows[near], *asked[i], best[i], k)

    def _scored(self, docs: np.ndarray, term: np.ndarray, idf: np.ndarray, best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        self.weight[term] = idf
        counts = self.own_count[docs]
        at = _ranges(self.own_start[docs], counts)
        score = np.bincount(np.repeat(np.arange(len(docs)), counts), self.own_impact[at] * self.weight[self.own_term[at]], len(docs))
        self.weight[term] = 0
        hit = np.flatnonzero(score >= (-best[-1][0] if len(best) == k else 1e-300))
        if len(hit) > 4 * k:
            hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
        return sorted(best + list(zip((-score[hit]).tolist(), self.docs[docs[hit]].tolist())))[:k]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` documents of highest BM25 for every query (``query_id, text``), exactly.

    A query is its distinct words; a document's score sums idf times impact over those it has. Ties go to the smaller doc_id;
    documents without a common word are left out. Words are compared by 64-bit hashes. Null texts are empty; rows without an
    id are left out; rows that share a doc_id are documents of their own; an empty table or query gives no rows.

    Index shards hold at most ``SHARD_DOCS`` documents and are built where the documents are read. Frequencies and the mean length
    are counted over all shards before any search, so scores are the same wherever a document lies. Queries go out in blocks of
    about ``QUERY_TERMS`` terms (a few MB); a task searches its shards one after the other, each with the bar
    the ones before it set, and sends ``k`` rows a query. The merge keeps the best ``k``.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "2")  # a row of the index is a whole shard
    try:
        return _top_k(spark, index, queries, k)
    finally:
        spark.conf.set(_BATCH, held)


def _top_k(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:

    def sizes(batches):
        for frame in batches:
            for row in frame["lengths"]:
                n = np.frombuffer(row, np.int64)
                yield pd.DataFrame({"n": [len(n)], "words": [int(n.sum())]})

    count, words = index.select("lengths").mapInPandas(sizes, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    mean = (words or 0) / max(1, count or 0)

    def split(batches):
        for frame in batches:
            yield pd.DataFrame({"query_id": frame["query_id"], "term": [_term_counts(t)[0].view(np.int64) for t in frame["text"]]})

    asked = queries.where(C("query_id").isNotNull()).select(C("query_id").cast("long").alias("query_id"), text_or_empty().alias("text")).dropDuplicates(["query_id"])
    asked = staged(asked.mapInPandas(split, "query_id long, term array<long>"), "queries")
    pairs = asked.select("query_id", F.explode("term").alias("term"))
    df = index.select("terms", "starts", "doc").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(float(count or 0)) - C("df") + 0.5) / (C("df") + 0.5))
    pairs = staged(pairs.join(df, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms")), "weighted")

    total = pairs.agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    n_blocks = max(1, -(-int(total[0] or 0) // max(1, QUERY_TERMS - int(total[1] or 0) // 2)))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    results = None
    for block in range(n_blocks):
        own = pairs.where(C("block") == block).select("query_id", C("terms.term").alias("term"), C("terms.idf").alias("idf")).toArrow()
        own = [(q, np.array(t, np.int64).view(np.uint64), np.array(w)) for q, t, w in zip(*(own[c].to_pylist() for c in ("query_id", "term", "idf")))]
        own = [(q, t[o], w[o]) for q, t, w in own for o in [np.argsort(t)]]
        sent = spark.sparkContext.broadcast((own, np.unique(np.concatenate([t for _, t, _ in own])) if own else np.zeros(0, np.uint64)))

        def search(batches, sent=sent):
            own, every = sent.value
            place = [np.searchsorted(every, t) for _, t, _ in own]
            best = [[] for _ in own]
            for frame in batches:
                for row in frame.itertuples():
                    shard = Shard(row, mean)
                    if not len(shard.terms):
                        continue
                    to = np.minimum(np.searchsorted(every, shard.terms), len(every) - 1)
                    known = np.flatnonzero(every[to] == shard.terms) if len(every) else to[:0]
                    at = np.full(len(every), -1)
                    at[to[known]] = known
                    asked = [(at[p][has], idf[has]) for p, (_, _, idf) in zip(place, own) for has in [at[p] >= 0]]
                    some = [i for i, (t, _) in enumerate(asked) if len(t)]
                    for few in batched(some, TOGETHER):
                        found = [best[i] for i in few]
                        shard.search([asked[i] for i in few], found, k)
                        for i, now in zip(few, found):
                            best[i] = now
            rows = [(q, d, -s) for (q, _, _), found in zip(own, best) for s, d in found]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "score"]).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(C("score").desc(), "doc_id"))
        found = index.mapInPandas(search, "query_id long, doc_id long, score double").withColumn("rank", rank).where(C("rank") <= k)
        found = staged(found.select("query_id", "rank", "doc_id", "score"), "top")
        results = found if results is None else results.unionByName(found)
    return results


@query("op7_search")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.where(C("doc_id") % 100 == 0).select(C("doc_id").alias("query_id"), "text"))
