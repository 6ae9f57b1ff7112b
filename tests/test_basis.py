import numpy as np
import pytest

from allelica.operators import fstats
from allelica.plans import basis
from tests.test_operators import simulated


def test_basis_reproduces_statistics_and_its_file(spark):
    m = simulated(spark)
    b = basis.fit(m, ["O", "A", "B", "C", "X"])
    quads = [("A", "B", "C", "O"), ("A", "B", "A", "B"), ("X", "A", "X", "B")]
    mean, cov = b.evaluate(quads)
    sums = fstats.general_blocks(m, quads).toPandas().groupby("qid")[["top", "n"]].sum()
    direct = (sums.top / sums.n).to_numpy()
    assert mean == pytest.approx(direct, abs=2e-3)
    d = fstats.f4_statistic(m, [("A", "B", "C", "O")]).first()
    assert np.sqrt(cov[0, 0]) == pytest.approx(d.se, rel=0.3)
    again = basis.Basis.load(b.dump())
    assert again.pops == b.pops and again.mean == pytest.approx(b.mean, abs=1e-9) and again.cov == pytest.approx(b.cov, abs=1e-9)
