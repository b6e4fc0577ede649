"""The span classifier weighs vote patterns as often as the corpus shows them."""

import numpy as np
import pytest

from loomline.llm import pii


def test_counts_have_no_cap():
    one = pii._ANCHORS[3]
    w = pii.train(np.array([one, one]), np.array([1e6, 1e3]), np.array([1.0, 0.0]))
    assert pii.Model(w).probability(np.array([one]))[0] == pytest.approx(1 / 1.001, abs=1e-4)


def test_large_counts_converge():
    patterns = np.array(pii._ANCHORS)
    post = np.linspace(1e-6, 1 - 1e-6, len(patterns))
    for size in (1.0, 1e3, 1e6, 1e9):
        counts = size * np.arange(1.0, len(patterns) + 1)
        w = pii.train(patterns, counts, post)
        x = pii._design(patterns)
        g = x.T @ (counts * (pii.Model(w).probability(patterns) - post)) + w
        assert np.abs(g).max() / counts.sum() < 1e-6
