"""Large groups of near copies: how many rows they take, and that nothing of them is lost."""

import numpy as np

from tickloom.llm import neardup


def test_large_groups_of_near_copies_are_settled(spark, monkeypatch):
    """Near copies take a bounded number of rows each and do not branch deeper (about 100 rows each did)."""
    made = {}
    staged = neardup.staged

    def counted(df, label, **options):
        out = staged(df, label, **options)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1200):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1200 + i, " ".join(f"v{int(x)}" for x in rng.integers(0, 10**6, 60))) for i in range(300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 1200 else i for i in range(1500)}
    assert made["members"] <= 30 * 1200
