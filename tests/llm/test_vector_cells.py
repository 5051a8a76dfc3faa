"""Cells of near-duplicate vectors: guests across their borders, and how many rows there are."""

import numpy as np
import pytest

from tickloom.llm import embeddings


def frame(spark, x, label):
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("cell,block", [(40, 64), (40, 16), (5000, 128)])
def test_links_across_cells_and_blocks(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)).astype(np.float32)
    x[800:] = x[:100]
    label = np.where(np.arange(900) % 9, 0, 1)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(900, dtype=bool)
    root = np.arange(900)
    while (low := np.minimum(root, np.where(link, root[None], 900).min(1))).tolist() != root.tolist():
        root = low
    got = {r["vec_id"]: r for r in embeddings.near_vectors(frame(spark, x, label)).collect()}
    assert [got[i]["n_links"] for i in range(900)] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(900)] == root.tolist()


def test_guests_do_not_grow_with_other_labels(spark, monkeypatch):
    """Only vectors of the own label count for the cells: labels that fill one cell have no guests."""
    made = {}
    staged = embeddings.staged

    def counted(df, label, **options):
        out = staged(df, label, **options)
        made[label] = out.count()
        return out

    monkeypatch.setattr(embeddings, "staged", counted)
    rng = np.random.default_rng(5)
    embeddings.near_vectors(frame(spark, rng.normal(size=(3000, 64)), rng.integers(0, 10, 3000))).count()
    assert made["vector-cells"] == 3000
