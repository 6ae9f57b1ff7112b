import numpy as np
import pytest

from allelica.operators import fstats
from allelica.plans import numeric
from tests.test_operators import simulated


def test_rank_dof():
    assert [numeric.rank_dof(3, 4, r) for r in range(4)] == [12, 6, 2, 0]


def test_rank_of_an_exact_product():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 1)) @ rng.normal(size=(1, 4))
    assert numeric.rank_test(x, np.eye(12), 1).chi_square == pytest.approx(0, abs=1e-12)
    assert numeric.rank_test(x, np.eye(12), 0).chi_square == pytest.approx((x * x).sum())


def test_shrinkage_keeps_the_trace():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    v = a @ a.T
    assert np.trace(numeric.shrink(v, 100)) == pytest.approx(np.trace(v))


def test_mixture_weights_of_simulated_populations(spark):
    m = simulated(spark, share=0.4, snps=6000)
    sums = fstats.f4_vector_blocks(m, ["X", "A", "B"], ["O", "C", "A"][:2] + ["B"])
    x, cov, deleted, weights = numeric.f4_matrix(sums, 2, 2)
    w, score, dof = numeric.admixture_weights(x, cov)
    se, _ = numeric.weight_errors(deleted, w, cov, weights)
    assert w.sum() == pytest.approx(1) and abs(w[0] - 0.4) < max(4 * se[0], 0.1) and dof == 1
    assert [s["pattern"] for s in numeric.sub_models(x, cov)] == ["00", "01", "10"]


def test_exponential_fit():
    d = np.linspace(0.5, 30, 60)
    assert numeric.exponential_fit(d, 0.1 + 2 * np.exp(-0.25 * d)) == pytest.approx((0.1, 2, 0.25), rel=1e-4)
