"""Exact vector search: what a task sends on is bounded."""

import numpy as np
import pyarrow as pa

from corpusq.operators import retrieval as R


def test_a_task_sends_the_nearest_vectors_of_all_its_rows(monkeypatch):
    """However many steps a task takes, a query has ``k`` rows at most; equal scores go by id."""
    rng = np.random.default_rng(3)
    own, asked = rng.integers(-2, 3, (500, 4)).astype(np.float64), rng.integers(-2, 3, (20, 4)).astype(np.float64)
    ids = rng.permutation(500)
    monkeypatch.setattr(R, "SIMILARITIES", 20 * 16)
    monkeypatch.setattr(R, "HELD", 150)
    shared = type("Shared", (), {"value": (list(range(100, 120)), R._unit(asked))})
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 130]), pa.array(own[i : i + 130].tolist())], ["id", "v"]) for i in range(0, 500, 130)]
    got = [(r["query_id"], r["id"], r["score"]) for b in R._nearest(shared, 5, 0.3)(iter(batches)) for r in b.to_pylist()]
    similar, want = np.round(R._unit(own) @ R._unit(asked).T, 6), []
    for q in range(20):
        want += [(100 + q, i, s) for s, i in sorted(((-s, i) for s, i in zip(similar[:, q], ids, strict=True) if s > 0.3))[:5] for s in [-s]]
    assert sorted(got) == sorted(want)
