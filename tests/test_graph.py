"""Admixture graphs: reading, editing, prediction and fit."""

import numpy as np
import pytest

from allelica.plans import basis, graph
from tests.test_operators import simulated

TEXT = """
root R
label O O
label A A
label B B
label C C
label X X   # the mixed one
edge o R O
edge q R Q
edge ab Q AB
edge b Q B0
edge bb B0 B
edge aa AB A0
edge a A0 A
edge c A0 C
admix XX AB B0 30 70
edge x XX X
"""


def test_chances_of_paths():
    g = graph.read(TEXT)
    c = g.chances()
    assert c["O"] == {"o": 1} and c["A"] == {"q": 1, "ab": 1, "aa": 1, "a": 1}
    assert c["X"] == pytest.approx({"q": 1, "ab": 0.3, "b": 0.7, "x": 1})
    assert graph.shape(graph.read(graph.dump(g))) == graph.shape(g)
    drawn = graph.dot(g, {"x": 0.01})
    assert "XX -> X [ label = \"10\" ]" in drawn and "B0 -> XX [ style=dotted, label = \"70%\" ]" in drawn


@pytest.mark.parametrize("more", ["edge o R Z", "edge z Y A", "admix A Q B0 1 1", "nonsense A"])
def test_bad_graphs(more):
    with pytest.raises(ValueError):
        graph.read(TEXT + more)


def test_edits():
    g = graph.read(TEXT)
    less = graph.without(g, "X")
    assert set(less.labels) == set("OABC") and not less.mixes and len(less.edges) == 6
    assert graph.without(graph.without(less, "C"), "A").chances()["B"].keys() == {"q"}
    split = graph.with_node(less, "o", "N")
    assert graph.shape(graph.simplified(split)) == graph.shape(less)
    turned = graph.reroot(less, "A0")
    pops = ["O", "A", "B", "C"]
    # f-statistics do not depend on the root.
    one, names = graph.design(less, pops)
    two, other = graph.design(turned, pops)
    shared = sorted(set(names) & set(other))
    for e in shared:
        if e not in ("o", "q"):
            assert one[:, names.index(e)].tolist() == two[:, other.index(e)].tolist()
    with pytest.raises(ValueError):
        graph.reroot(g, "X")


def test_nonnegative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, want = rng.normal(size=(12, 5)), np.maximum(rng.normal(size=5), 0)
        assert graph.nonnegative(a, a @ want) == pytest.approx(want, abs=1e-8)
        b = rng.normal(size=12)
        x = graph.nonnegative(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-7).all() and slope[x > 0] == pytest.approx(0, abs=1e-7)


def test_fit_recovers_drifts_and_shares_of_an_exact_basis():
    g = graph.read(TEXT.replace("admix XX AB B0 30 70", "admix XX A0 B0 50 50"))
    pops = ["O", "A", "B", "C", "X"]
    rows, names = graph.design(g, pops, {"XX": 0.3})
    drifts = np.linspace(0.01, 0.05, len(names))
    mean = rows @ drifts
    found = basis.Basis(pops, mean, 1e-6 * np.eye(len(mean)), 50, 50.0)
    got = graph.fit(g, found)
    assert got.score < 1e-4 and got.shares["XX"] == pytest.approx(0.3, abs=1e-3) and not got.outliers
    assert got.fitted == pytest.approx(mean, abs=1e-7)


def test_fit_of_simulated_populations(spark):
    found = basis.fit(simulated(spark, share=0.3, snps=6000), ["O", "A", "B", "C", "X"])
    g = graph.read(TEXT.replace("admix XX AB B0 30 70", "admix XX A0 B0 50 50"))
    got = graph.fit(g, found)
    assert abs(got.shares["XX"] - 0.3) < 0.15 and got.tail > 1e-4
    alone = graph.fit(graph.read(TEXT.replace("admix XX AB B0 30 70", "edge w B0 XX")), found)
    assert alone.score > got.score + 10 and alone.outliers
