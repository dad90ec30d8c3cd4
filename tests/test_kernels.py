"""The NumPy helpers: closed forms, optimality conditions, monotonicity."""

import numpy as np
import pytest

from panelweave.functions.kernels import (_sweeps, GAP, blocks, min_variance, newton_precision, optimality_gap, recurrent_forward, soft,
                                          solve_component, solve_lasso, sparse_precision,
                                          symmetric, weighted_lasso)


def random_cov(k, m, seed, scale=1e-3):
    rng = np.random.default_rng(seed)
    x = (0.5 * rng.standard_normal((1, m)) + rng.standard_normal((k, m))) * scale
    return x @ x.T


def test_two_assets_closed_form():
    s = np.array([[2.0, 1.0], [1.0, 2.0]])
    omega, _, _ = sparse_precision(s, 0.0, tol=1e-12)
    assert np.allclose(omega, np.array([[2, -1], [-1, 2]]) / 3, atol=1e-8)
    omega, _, _ = sparse_precision(s, 1.0)
    assert np.allclose(omega, np.diag([0.5, 0.5])) and omega[0, 1] == 0.0
    assert np.allclose(min_variance(s), [0.5, 0.5])
    assert np.allclose(min_variance(np.diag([1.0, 3.0])), [0.75, 0.25])


@pytest.mark.parametrize("k,m,seed", [(5, 30, 1), (20, 60, 2), (60, 200, 3)])
def test_precision_is_optimal_and_thins_out(k, m, seed):
    s = random_cov(k, m, seed)
    off = np.abs(s[~np.eye(k, dtype=bool)])
    counts = []
    for lam in np.quantile(off, [0.1, 0.5, 0.9]):
        omega, _, gap = sparse_precision(s, lam)
        assert gap < 1e-4 and gap == pytest.approx(optimality_gap(s, omega, lam))
        assert np.allclose(np.diag(np.linalg.inv(omega)), np.diag(s), rtol=1e-5)
        counts.append(np.count_nonzero(omega))
    assert counts[0] > counts[1] > counts[2]


def test_precision_at_published_scale():
    """Realised covariances are tiny; the solver must not depend on their size."""
    s = random_cov(15, 390, 4, scale=1e-4)
    lam = 3e-6 * np.mean(np.diag(s)) / 1e-4
    a, _, gap_a = sparse_precision(s, lam)
    b, _, gap_b = sparse_precision(s * 1e6, lam * 1e6)
    assert gap_a < 1e-3 and gap_b < 1e-3 and np.allclose(a, b * 1e6, rtol=1e-6)


def test_precision_converges_after_factor_removal():
    """Nearly singular matrices: 500 steps alone leave the conditions open by several times lam."""
    rng = np.random.default_rng(1)
    for _ in range(5):
        s = np.cov(rng.standard_normal((6, 30)) * [[300.0], [100.0], [30.0], [10.0], [3.0], [1.0]])
        val, vec = np.linalg.eigh(s)
        s = (vec[:, :-1] * val[:-1]) @ vec[:, :-1].T + 1e-2 * np.eye(6)
        for lam in (2.0, 0.5, 0.05):
            omega, _, gap = sparse_precision(s, lam, max_iter=500)
            assert gap <= GAP and gap == pytest.approx(optimality_gap(s, omega, lam))


@pytest.mark.parametrize("k,m,lam", [(25, 30, 2.0), (60, 30, 20.0), (150, 30, 2.0)])
def test_precision_converges_with_few_bars(k, m, lam):
    """Rank 30, a ridge of 1e-2 and penalties far below the variances: conditions from the definition."""
    rng = np.random.default_rng(k)
    x = rng.exponential(size=(k, m)) * rng.uniform(2, 6, (k, 1)) * 2
    s = x @ x.T + 1e-2 * np.eye(k)
    omega, _, gap = sparse_precision(s, lam)
    w, off = np.linalg.inv(omega), ~np.eye(k, dtype=bool)
    assert gap <= GAP and np.abs(np.diag(w - s)).max() <= 1e-3 * lam
    on = (omega != 0) & off
    assert np.abs((w - s - lam * np.sign(omega))[on]).max() <= 1e-3 * lam and np.abs((w - s)[off]).max() <= (1 + 1e-3) * lam
    assert np.linalg.eigvalsh(omega)[0] > 0


def test_components_are_solved_apart():
    """Screening changes nothing: whole solves agree with those of each block, and cells across blocks are zero."""
    s = np.zeros((25, 25))
    s[:12, :12], s[12:, 12:] = random_cov(12, 40, 5), random_cov(13, 40, 6)
    s[:12, 12:] = s[12:, :12] = 1e-7
    order = np.random.default_rng(7).permutation(25)
    lam = 5e-6
    found = [b.tolist() for b in blocks((np.abs(s) > lam)[np.ix_(order, order)])]
    assert sorted(map(len, found)) == sorted(map(len, (b.tolist() for b in blocks(np.abs(s) > lam)))) and len(found) > 1
    omega, _, gap = sparse_precision(s, lam)
    whole, _ = solve_component(s, lam, None, 5000, 1e-11)
    assert gap <= GAP / 10 and np.allclose(omega, whole, atol=1e-4 * np.abs(omega).max())
    assert not omega[:12, 12:].any() and not whole[:12, 12:].any()
    again, _, _ = sparse_precision(s[np.ix_(order, order)], lam)
    assert np.allclose(again, omega[np.ix_(order, order)], atol=1e-6 * np.abs(omega).max())


@pytest.mark.parametrize("seed,corr", [(1, 0.0), (2, 0.4), (3, 0.7)])
def test_screened_paths_reach_the_same_optimum(seed, corr):
    """Along a path with the strong rule, against every row swept at once; the conditions hold on all rows."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 60)) * (1 - corr) + corr * rng.standard_normal((300, 1))
    y = x[:, :6] @ rng.standard_normal((6, 4)) + 0.3 * rng.standard_normal((300, 4))
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean(0)
    x[:, 59] = 0.0  # a column without any movement takes no part
    gram, cross = x.T @ x / 300, x.T @ y / 300
    weight = rng.uniform(0.5, 2.0, (60, 4))
    beta, before = np.zeros((60, 4)), None
    for lam in np.geomspace(1.0, 1e-3, 9):
        pen = lam * weight
        beta, done = solve_lasso(gram, cross, pen, beta.copy(), 1e-12, 200, before)
        assert done
        if corr < 0.5:  # where plain sweeps get there
            whole = np.zeros((60, 4))
            whole[:59] = _sweeps(gram[:59, :59], cross[:59], pen[:59], whole[:59], 1e-11, 5000)[0]
            assert np.allclose(beta, whole, atol=1e-7)
        g = cross - gram @ beta
        assert (np.abs(g) - pen).max() <= 1e-9 and np.abs(np.where(beta != 0, g - pen * np.sign(beta), 0)).max() <= 1e-9
        before = pen


def test_newton_directions_need_no_system_of_cells():
    s = random_cov(150, 400, 8)
    d = np.sqrt(np.diag(s))
    r, lam = s / np.outer(d, d), 0.15
    pen = lam * (1 - np.eye(150))
    z, steps = newton_precision(r, pen, np.eye(150), lambda m: optimality_gap(r, m, lam))
    assert steps < 50 and optimality_gap(r, z, lam) <= GAP / 10


def test_lasso_says_whether_it_converged():
    rng = np.random.default_rng(8)
    g, c, pen = random_cov(10, 40, 6, 1.0) / 40, rng.standard_normal((10, 2)), np.full((10, 2), 0.01)
    assert not solve_lasso(g, c, pen, np.zeros((10, 2)), max_sweeps=2, exact=1)[1]
    early, ended = solve_lasso(g, c, pen, np.zeros((10, 2)), max_sweeps=2)
    beta, converged = solve_lasso(g, c, pen, np.zeros((10, 2)))
    assert ended and np.allclose(early, beta, atol=1e-8)
    assert converged and np.array_equal(beta, weighted_lasso(g, c, pen, np.zeros((10, 2))))


def test_lasso_on_orthonormal_design_is_soft_threshold():
    rng = np.random.default_rng(0)
    c = rng.standard_normal((12, 4))
    beta = weighted_lasso(np.eye(12), c, np.full((12, 4), 0.5), np.zeros((12, 4)))
    assert np.allclose(beta, soft(c, 0.5))


def test_lasso_optimality_and_warm_start():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 30)) @ rng.standard_normal((30, 30))
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, :3] @ rng.standard_normal((3, 6)) + rng.standard_normal((200, 6))
    g, c = x.T @ x / 200, x.T @ (y - y.mean(0)) / 200
    pen = rng.uniform(0.05, 0.3, (30, 6))
    pen[3] = 0.0
    beta = weighted_lasso(g, c, pen, np.zeros((30, 6)))
    r = c - g @ beta
    on = beta != 0
    assert np.abs(r - pen * np.sign(beta))[on].max() < 1e-8
    assert (np.abs(r) - pen)[~on].max() < 1e-8
    warm = weighted_lasso(g, c, pen, weighted_lasso(g, c, pen * 3, np.zeros((30, 6))))
    assert np.allclose(warm, beta, atol=1e-8)


def test_lasso_path_thins_out_and_singular_columns_stay_zero():
    rng = np.random.default_rng(6)
    g = random_cov(10, 40, 6, 1.0) / 40
    g[4] = g[:, 4] = 0.0
    c = rng.standard_normal((10, 2))
    c[4] = 0.0
    counts = [np.count_nonzero(weighted_lasso(g, c, np.full((10, 2), lam), np.zeros((10, 2))))
              for lam in (0.01, 0.3, 1.0)]
    assert counts[0] >= counts[1] >= counts[2]
    assert not weighted_lasso(g, c, np.full((10, 2), 0.01), np.zeros((10, 2)))[4].any()


def test_recurrent_with_zero_parameters_is_uniform():
    gates = {g: (np.zeros((4, 7)), np.zeros(4)) for g in "fioc"}
    y = recurrent_forward(np.random.default_rng(0).standard_normal((3, 5, 3)), gates, (np.zeros((6, 4)), np.zeros(6)))
    assert np.allclose(y, 1 / 6)


def test_recurrent_against_one_step_by_hand():
    def sig(a):
        return 1 / (1 + np.exp(-a))

    gates = {"f": (np.array([[0.3, 0.1]]), np.array([1.0])), "i": (np.array([[0.2, -0.4]]), np.array([0.0])),
             "o": (np.array([[-0.5, 0.6]]), np.array([0.1])), "c": (np.array([[0.9, 0.2]]), np.array([0.0]))}
    h = c = 0.0
    for x in (0.7, -1.2):
        c = sig(0.3 * x + 0.1 * h + 1.0) * c + sig(0.2 * x - 0.4 * h) * np.tanh(0.9 * x + 0.2 * h)
        h = sig(-0.5 * x + 0.6 * h + 0.1) * np.tanh(c)
    score = np.array([2.0 * h, -1.0 * h]) / 0.5
    want = np.exp(score) / np.exp(score).sum()
    got = recurrent_forward(np.array([[[0.7], [-1.2]]]), gates, (np.array([[2.0], [-1.0]]), np.zeros(2)))
    assert np.allclose(got, want)


def test_symmetric():
    names, m = symmetric(np.array(["a", "a", "b"]), np.array(["a", "b", "b"]), np.array([1.0, 2.0, 3.0]))
    assert list(names) == ["a", "b"] and m.tolist() == [[1.0, 2.0], [2.0, 3.0]]
