"""Search in one shard: exact against all scores, and how few documents are scored."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tickloom.llm import search


def _shard(rng, n, size, ids):
    """A shard of ``n`` random documents over words of falling frequency, and the texts."""
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, size) if x < 5000) for _ in range(n)]
    texts[n // 2] = texts[1]
    row = next(search._build(iter([pd.DataFrame({"doc_id": ids, "text": texts})])))
    return search.Shard(SimpleNamespace(**{c: row[c][0] for c in row.columns}), float(size)), texts


def _asked(shard, text):
    term = search._term_counts(text)[0]
    at = np.minimum(np.searchsorted(shard.terms, term), len(shard.terms) - 1)
    at = at[shard.terms[at] == term]
    return at, np.log1p((len(shard.docs) - shard.count[at] + 0.5) / (shard.count[at] + 0.5))


def _all_scores(shard, term, idf):
    score = np.zeros(len(shard.docs))
    for t, w in zip(term, idf):
        at = slice(shard.starts[t], shard.starts[t] + shard.count[t])
        score[shard.doc[at]] += shard.impact[at] * w
    return sorted(zip((-score[score > 0]).tolist(), shard.docs[score > 0].tolist()))


@pytest.mark.parametrize("n,size,common_terms", [(3, 20, 2048), (500, 60, 2048), (500, 60, 0), (700, 150, 40)])
def test_two_shards_against_all_scores(monkeypatch, n, size, common_terms):
    monkeypatch.setattr(search, "COMMON_TERMS", common_terms)
    rng = np.random.default_rng(n + size)
    one, texts = _shard(rng, n, size, np.arange(n) * 2)
    two, _ = _shard(rng, n, size, np.arange(n) * 2 + 1)
    queries = [*texts[:20], "w1 w2", "w1"]
    best = [[] for _ in queries]
    expected = [[] for _ in queries]
    for shard in (one, two):
        asked = [_asked(shard, q) for q in queries]
        shard.search(asked, best, 10)
        expected = [sorted(e + _all_scores(shard, *a))[:10] for e, a in zip(expected, asked)]
    assert best == expected


def test_few_documents_are_scored(monkeypatch):
    """Estimates settle all but about ``k`` documents a query, also in the first shard, where no bar is known."""
    shard, texts = _shard(np.random.default_rng(3), 2000, 200, np.arange(2000))
    scored = []
    monkeypatch.setattr(shard, "_scored", lambda docs, *rest, real=shard._scored: scored.append(len(docs)) or real(docs, *rest))
    best = [[] for _ in range(40)]
    shard.search([_asked(shard, t) for t in texts[:40]], best, 10)
    assert all(len(b) == 10 for b in best) and sum(scored) <= 40 * 15
