"""Language ID: exactness of the segments' messages, fitting in bounded pieces."""

import numpy as np
import pytest

pytest.importorskip("veranda.llm")
from veranda.llm import langid  # noqa: E402


def test_segments_are_exact():
    g = np.random.default_rng(2)
    scores, a = (3 * g.normal(size=(900, 4))).astype(np.float32), g.normal(size=(4, 4)).astype(np.float32)
    first, count = np.array([0, 1, 7, 60, 200]), np.array([1, 6, 53, 140, 700])
    want = langid.forward_backward(scores, first, count, a, 10**6)
    for width in (1, 2, 7, 64):
        assert np.allclose(langid.forward_backward(scores, first, count, a, width), want, atol=1e-5)


def test_expected_transitions_equal_sums_over_paths():
    g = np.random.default_rng(3)
    scores, a = g.normal(size=(4, 2)).astype(np.float32), g.normal(size=(2, 2)).astype(np.float32)
    total, want = 0.0, np.zeros((2, 2))
    for path in np.ndindex(2, 2, 2, 2):
        w = np.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        total += w
        for x, y in zip(path, path[1:]):
            want[x, y] += w
    assert np.allclose(langid._expected(scores, np.array([0]), np.array([4]), a)[1], want / total, atol=1e-4)


def test_fit_does_not_hang_on_the_size_of_its_pieces():
    texts = ["the cat and the dog " * 30 + "\nof the house", "der hund und die katze " * 40, "le chat et le chien\n" * 25]
    whole, parts = (langid.fit(texts, ["en", "de", "fr"], rounds=3, chunk=c) for c in (1 << 20, 50))
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(whole.tables(), parts.tables(), strict=True))
