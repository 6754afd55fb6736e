import itertools

import numpy as np
import pytest

from tracewell.functions import kernels as k
from tracewell.functions import special


def test_plateau_counts_once_at_its_middle_and_edges_never():
    assert k.local_maxima(np.array([5.0, 1, 3, 3, 3, 3, 1, 2, 0, 9])).tolist() == [3, 7]


def test_distance_keeps_the_higher_peak():
    x = np.array([0, 5, 0, 6, 0, 4, 0, 0, 0, 3, 0], dtype=float)
    assert k.find_peaks(x, 3).tolist() == [3, 9]
    assert k.find_peaks(x, 1, prominence=4.5).tolist() == [1, 3]


def test_prominence_and_width_of_a_triangle():
    x = np.array([0, 1, 2, 3, 2, 1, 0], dtype=float)
    prom, left, right = k.prominences(x, np.array([3]))
    assert (prom[0], left[0], right[0]) == (3.0, 0, 6)
    assert k.widths(x, np.array([3]))[0] == pytest.approx(3.0)


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(3)
    for _ in range(20):
        cost = rng.random(shape)
        i, j = k.assignment(cost)
        assert len(i) == min(shape) and len(set(j)) == len(j)
        small, c = min(shape), cost if shape[0] <= shape[1] else cost.T
        best = min(c[np.arange(small), list(p)].sum() for p in itertools.permutations(range(c.shape[1]), small))
        assert cost[i, j].sum() == pytest.approx(best)


def test_single_linkage_is_connected_components():
    x = np.array([0.0, 1, 2, 10, 11, 30])
    d = np.abs(x[:, None] - x[None, :])
    assert k.flat_clusters(k.linkage(d, "single"), 6, 1.5).tolist() == [1, 1, 1, 2, 2, 3]
    assert k.linkage(d, "average")[-1][3] == 6


def test_hull_shift_dtw_and_arrivals():
    assert k.hull_area(np.array([[0, 0], [2, 0], [2, 1], [0, 1], [1, 0.5]])) == 2.0
    rng = np.random.default_rng(1)
    a = rng.random((64, 64))
    assert k.phase_shift(a, np.roll(a, (5, -7), (0, 1)), 12) == (-5, 7)
    x = np.sin(np.linspace(0, 6, 30))
    assert k.soft_dtw(x, x, 0.01) < k.soft_dtw(x, -x, 0.01)
    lags = np.array([2.0, 2, 4])
    t = k.graph_arrivals(3, np.array([[0, 1], [1, 2], [0, 2]]), lags, np.ones(3))
    assert np.allclose(np.diff(t), 2)


def test_front_scores():
    rng = np.random.default_rng(2)
    c = rng.random((100, 2)) * 100
    assert k.linear_r2(np.column_stack([np.ones(100), c]), c @ [1.0, 2.0]) > 0.999
    assert k.radial_scores(c, np.hypot(*(c - [50, 50]).T))[0] > 0.95


def test_distributions_against_table_values():
    assert special.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert special.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert special.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert special.mann_whitney_p(0, 3, 3) == pytest.approx(0.1)
    assert special.wilcoxon_p(0, 5) == pytest.approx(0.0625)
    assert special.kolmogorov_p(0.0, 10, 10) == 1.0
