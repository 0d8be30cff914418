"""Small-array operators against textbook values and identities."""

import math

import numpy as np
import pytest

from signalmesh.functions import numeric as nm
from signalmesh.operators import clustering as cl
from signalmesh.operators import cv, linear, multiplicity, shapes, shrinkage


def test_average_ranks_share_ties():
    assert nm.average_ranks([3, 1, 2, 2]).tolist() == [4, 1, 2.5, 2.5]


def test_hac_equals_direct_sum():
    x = np.random.default_rng(1).normal(size=200).cumsum() * 0.1
    d = x - x.mean()
    v = d @ d / 200 + 2 * sum((1 - j / 26) * (d[:-j] @ d[j:]) / 200 for j in range(1, 26))
    assert nm.hac_variance(x) == pytest.approx(v)
    gap = np.insert(x, 50, np.nan)
    assert nm.newey_west(gap) == pytest.approx(nm.newey_west(x))
    assert math.isnan(nm.newey_west(np.array([1.0]))[0])


@pytest.mark.parametrize("p, df, q", [(0.975, 2, 4.3027), (0.975, 10, 2.2281), (0.95, 1, 6.3138)])
def test_t_quantiles(p, df, q):
    assert nm.t_quantile(p, df) == pytest.approx(q, abs=1e-4)


def test_folds_cover_and_keep_their_distance():
    seen = np.zeros(300, int)
    for _, train, test in cv.purged_kfold(300):
        seen += test
        t = np.flatnonzero(test)
        assert all(abs(t - d).min() > 21 for d in np.flatnonzero(train))
    assert (seen == 1).all()
    a, b = cv.inner_split(np.ones(200, bool), 200)
    assert np.flatnonzero(b).min() - np.flatnonzero(a).max() >= 21


def test_pooling_identities():
    e, s = np.array([0.01, 0.05, 0.02, 0.06, 0.03]), np.full(5, 0.003)
    dl, pm, reml = shrinkage.tau2_dl(e, s), shrinkage.tau2_pm(e, s), shrinkage.tau2_reml(e, s)
    assert dl > 0 and reml > 0 and pm == pytest.approx(dl, rel=1e-4)
    assert all(f([0.020, 0.021, 0.019, 0.020], np.full(4, 0.005)) == 0 for f in (shrinkage.tau2_dl, shrinkage.tau2_pm))
    shrunk, tau2 = shrinkage.dl_shrink(np.array([0.020, 0.021, 0.019]), np.full(3, 0.01))
    assert tau2 == 0 and shrunk == pytest.approx(np.full(3, 0.02))
    lo = shrinkage.hartung_knapp_interval([0.01, 0.03, 0.02], np.full(3, 0.005), 0.0)
    assert lo[1] < lo[0] < lo[2]
    assert math.isnan(shrinkage.hartung_knapp_interval([0.01], np.array([0.005]), 0.0)[1])
    assert shrinkage.equal_block_weights([-0.3]).tolist() == [1.0]


def test_multiplicity_textbook():
    p = [0.01, 0.04, 0.03, 0.20]
    assert multiplicity.holm(p) == pytest.approx([0.04, 0.09, 0.09, 0.20])
    assert multiplicity.benjamini_hochberg(p) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_clusters_of_planted_blocks():
    c = np.eye(6)
    c[:3, :3] = c[3:5, 3:5] = 0.9
    np.fill_diagonal(c, 1)
    assert cl.cluster_labels(c).tolist() == [1, 1, 1, 2, 2, 3]
    for m in cl.LINKAGES:
        assert len(set(cl.hier_labels_k(c, 3, m))) == 3
    assert len(set(cl.divisive_labels(c, 3))) == 3
    assert sorted(cl.random_labels(6, 3, 1)) == [1, 1, 2, 2, 3, 3]
    s = np.array([1, -1, 1, 1, 1, 1.0])
    assert cl.orientation_flips(c * np.outer(s, s), list("abcdef")) == ["b"]
    b = cl.block_matrix(np.array([1, 1, 2, 3, 3, 3]), np.array([1, -1, 1, 1, 1, -1]))
    assert np.abs(b).sum(0) == pytest.approx([1, 1, 1]) and b[:, 0].tolist() == [0.5, -0.5, 0, 0, 0, 0]
    assert sorted(cl.clustered_order(c)) == list(range(6))


def test_pls_spans_from_covariance_to_least_squares():
    x = np.random.default_rng(2).normal(size=(300, 4))
    y = x @ [1, 2, -1, 0.5] + np.random.default_rng(3).normal(size=300)
    z = (x - x.mean(0)) / x.std(0)
    c, g = z.T @ z / 300, z.T @ (y - y.mean()) / 300
    one = linear.pls_coefficients(c, g, 1)
    assert np.cross(one[:2], g[:2]) == pytest.approx(0, abs=1e-10)
    assert linear.pls_coefficients(c, g, 4) == pytest.approx(np.linalg.solve(c, g))
    assert linear.pls_coefficients(c, np.zeros(4), 2).tolist() == [0] * 4
    counts = [np.count_nonzero(linear.lasso_path_point(c, g, f)) for f in (0.99, 0.5, 0.02)]
    assert counts == sorted(counts) and counts[0] == 1


def test_stumps_equal_row_boosting():
    rng = np.random.default_rng(4)
    x, n, bins = rng.random((2000, 2)), 2000, 8
    y = np.sin(3 * x[:, 0]) + 0.1 * rng.normal(size=n)
    b = (x * bins).astype(int) + np.arange(2) * bins
    hot = np.zeros((n, 2 * bins))
    hot[np.arange(n)[:, None], b] = 1
    out = shapes.boost_stumps(hot.T @ hot, hot.T @ y, y.mean(), 2, rounds=50, min_rows=10)
    left = y - y.mean() - out[0][b[:, 0]] - out[1][b[:, 1] - bins]
    assert left.var() < 0.5 * y.var()
    assert sum(shapes.shape_response_split(shapes.tabulated(out))) == pytest.approx(1)
