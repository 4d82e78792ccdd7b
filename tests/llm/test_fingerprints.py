"""Fingerprints of very long texts, and successors over the bounds of buckets."""

import numpy as np
import pytest

pytest.importorskip("veranda.llm")
from veranda.llm import fingerprints  # noqa: E402


def test_large_disjoint_sets_share_no_sample():
    g = np.random.default_rng(1)
    s = fingerprints.Sampler()
    sets = [np.unique(g.integers(0, 1 << 63, 500_000, dtype=np.uint64)) for _ in range(4)]
    prints = [s.sample(x, np.ones(len(x), np.int64)) for x in sets]
    assert all((a != b).all() for i, a in enumerate(prints) for b in prints[:i])
    both = s.sample(np.unique(np.concatenate(sets[:2])), np.ones(len(np.union1d(*sets[:2])), np.int64))
    assert abs((both == prints[0]).mean() - 0.5) < 0.2 and ((both == prints[0]) | (both == prints[1])).all()


def test_successors_with_many_repeated_and_null_ids(spark):
    rows = [(i % 40 if i < 150 else None, f"w{i} " * 8) for i in range(170)]
    got = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(len(r.fingerprint) == 64 * 16 for r in got)
