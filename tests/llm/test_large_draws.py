"""Draws from more than a billion rows follow the exact law."""

from math import comb

import numpy as np

from sqlscope.llm import sharding


def test_draws_beyond_a_billion():
    rng = np.random.default_rng(3)
    got = np.array([sharding._draw(np.array([1000, 4 * 10**9]), 10**6, rng) for _ in range(4000)])
    # about a Poisson law with mean 0.25
    assert abs((got[:, 0] == 0).mean() - 0.7788) < 0.03 and (got.sum(axis=1) == 10**6).all()


def test_inversion_follows_the_law():
    rng = np.random.default_rng(4)
    for good, bad, n in ((7, 5, 6), (40, 100, 30), (3, 2, 5), (1, 9, 0)):
        got = np.bincount([sharding._invert(good, bad, n, rng) for _ in range(20_000)], minlength=n + 1) / 20_000
        law = [comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(n + 1)]
        assert np.abs(got - law).max() < 0.02
