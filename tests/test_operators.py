"""Hand-sized fixtures for the Spark operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.columns import log10_normal_tail, mixed_integer, sigmoid, softmax
from panelweave.operators import covariance as cv
from panelweave.operators import evaluate as ev
from panelweave.operators import features as ft
from panelweave.operators import network as nw
from panelweave.operators import penalty as pn
from panelweave.operators import portfolio as pf
from panelweave.operators import quality as q
from panelweave.operators.confidence_set import bootstrap_means, mcs
from panelweave.operators.panel import densify
from panelweave.sources import files
from panelweave.sources.scratch import scratch_path

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]


def panel(spark, values, name="w"):
    """{asset: [v0, v1, ...]} -> (day, asset, name)."""
    return spark.createDataFrame([(D[k], a, float(v)) for a, vs in values.items() for k, v in enumerate(vs)],
                                 f"day date, asset string, {name} double")


def returns(spark, k, m, days, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((days, m, k)) * 0.01
    rows = [(D[d], b, f"a{i}", float(x[d, b, i])) for d in range(days) for b in range(m) for i in range(k)]
    return spark.createDataFrame(rows, "day date, bar int, asset string, ret double"), x


def as_dict(df, *keys):
    value = [c for c in df.columns if c not in keys]
    return {tuple(r[k] for k in keys): (r[value[0]] if len(value) == 1 else tuple(r[v] for v in value))
            for r in df.collect()}


def test_densify_fills_absent_cells(spark):
    cells = spark.createDataFrame([(D[0], "a", 1.0), (D[1], "b", 2.0)], "day date, asset string, value double")
    uni = spark.createDataFrame([("a",), ("b",), ("c",)], "asset string")
    got = as_dict(densify(cells, uni, 0.0), "day", "asset")
    assert len(got) == 6 and got[D[0], "a"] == 1.0 and got[D[1], "c"] == 0.0


def test_realized_cov_blocks_and_tiles_agree_with_numpy(spark):
    rets, x = returns(spark, 7, 23, 3)
    for args in ({}, {"bar_block": 4}, {"bar_block": 5, "tiles": 3}):
        got = as_dict(cv.realized_cov(rets, ridge=1e-6, **args), "day", "i", "j")
        assert len(got) == 3 * 28
        for d in range(3):
            want = x[d].T @ x[d] + 1e-6 * np.eye(7)
            for i in range(7):
                for j in range(i, 7):
                    assert got[D[d], f"a{i}", f"a{j}"] == pytest.approx(want[i, j], abs=1e-15)


def test_realized_cov_spreads_a_day_that_holds_most_rows(spark):
    """One day with 40 times the bars of the others is cut into groups of bounded size."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 3))
    rows = [(D[0], b, f"a{i}", float(x[b, i])) for b in range(4000) for i in range(3)]
    rows += [(D[1], b, f"a{i}", 1.0) for b in range(100) for i in range(3)]
    rets = spark.createDataFrame(rows, "day date, bar int, asset string, ret double")
    got = as_dict(cv.realized_cov(rets, bar_block=256), "day", "i", "j")
    assert got[D[0], "a0", "a2"] == pytest.approx(float(x[:, 0] @ x[:, 2]))
    assert got[D[1], "a1", "a1"] == pytest.approx(100.0)


def test_rolling_cov_never_sees_the_day_itself(spark):
    rets, _ = returns(spark, 2, 5, 8)
    base = as_dict(cv.rolling_cov(cv.realized_cov(rets), 3), "day", "i", "j")
    changed = rets.withColumn("ret", F.when(F.col("day") >= F.lit(D[5]), 9.0).otherwise(F.col("ret")))
    again = as_dict(cv.rolling_cov(cv.realized_cov(changed), 3), "day", "i", "j")
    for key, v in base.items():
        if key[0] <= D[5]:
            assert again[key] == pytest.approx(v)
        else:
            assert again[key][0] != pytest.approx(v[0])


def test_glasso_rows_and_ridge_chain(spark):
    good, twin = np.array([[2.0, 1.0], [1.0, 2.0]]), np.ones((2, 2))
    rows = [(day, a, b, float(m[i, j])) for day, m in ((D[0], good), (D[1], twin))
            for a, i in (("x", 0), ("y", 1)) for b, j in (("x", 0), ("y", 1)) if i <= j]
    cov = spark.createDataFrame(rows, "day date, i string, j string, v double")
    got = {(r["day"], r["lambda"]): r for r in cv.glasso(cov, [0.0, 1.0], ridges=(0.0, 1e-2)).collect()}
    assert got[D[0], 0.0]["ridge_used"] == 0.0 and got[D[1], 0.0]["ridge_used"] == 1e-2
    assert got[D[0], 1.0]["n_edges"] == 0 and got[D[0], 0.0]["n_edges"] == 1
    assert got[D[0], 0.0]["v"] == pytest.approx([2 / 3, -1 / 3, 2 / 3], abs=1e-6)
    failed = {r["day"]: r["status"] for r in cv.glasso(cov, [0.0]).collect()}
    assert failed == {D[0]: "ok", D[1]: "failed"}
    ok, bad = files.split_failed(cv.solve_status(cv.glasso(cov, [0.0])))
    assert [r["day"] for r in ok.collect()] == [D[0]] and [r["day"] for r in bad.collect()] == [D[1]]


def test_glasso_stopped_by_its_cap_is_failed(spark):
    x = np.random.default_rng(3).standard_normal((70, 20))
    s = x @ x.T + 1e-4 * np.eye(70)
    cov = spark.createDataFrame([(D[0], f"a{i:02}", f"a{j:02}", float(s[i, j])) for i in range(70) for j in range(i, 70)],
                                "day date, i string, j string, v double")
    bad = cv.glasso(cov, [0.1], ridges=(0.0,), max_iter=5).collect()[0]
    assert bad["status"] == "failed" and not bad["v"]
    assert bad["gap"] > 1e-3 and bad["iterations"] >= 5  # what its last solve came to
    good = cv.glasso(cov, [0.1], ridges=(0.0, 1e-3)).collect()[0]
    assert good["status"] == "ok" and good["gap"] <= 1e-3 and good["ridge_used"] == 0.0


def test_glasso_is_optimal_on_real_panels(spark, sf_dir):
    from panelweave.sources import bindings as b

    cov = cv.realized_cov(b.trade_returns(spark, sf_dir), ridge=1e-3)
    solved = cv.glasso(cov, [0.5, 5.0], ridges=(0.0, 1e-2, 1.0))
    rows = solved.select("lambda", "status", "gap", "n_edges").collect()
    assert all(r["status"] == "ok" for r in rows)
    assert np.median([r["gap"] for r in rows]) < 1e-4
    assert (sum(r["n_edges"] for r in rows if r["lambda"] == 0.5)
            > sum(r["n_edges"] for r in rows if r["lambda"] == 5.0))


def test_factor_removal_leaves_the_residual_covariance(spark):
    rets, x = returns(spark, 6, 40, 2, seed=3)
    bars = rets.groupBy("day").agg(F.count_distinct("bar").cast("double").alias("n_bars"))
    solved = cv.glasso(cv.realized_cov(rets), [1e-4, 1e-3], ridges=(1e-5,), n_factors=1)
    chosen = pn.bic_choice(solved, bars).collect()
    assert chosen == pn.factor_bic(rets, 1, [1e-4, 1e-3], ridges=(1e-5,)).collect()
    by = {(r["day"], r["lambda"]): r for r in solved.collect()}
    for row in chosen:
        scores = {}
        for lam in (1e-4, 1e-3):
            r = by[row["day"], lam]
            scores[lam] = 40 * (r["trace"] - r["log_det"]) + math.log(40) * r["n_edges"]
        assert row["lambda"] == min(scores, key=scores.get)
        assert row["bic"] == pytest.approx(min(scores.values()))
    s = x[0].T @ x[0]
    val, vec = np.linalg.eigh(s)
    resid = s - val[-1] * np.outer(vec[:, -1], vec[:, -1]) + 1e-5 * np.eye(6)
    r = by[D[0], 1e-4]
    omega = np.zeros((6, 6))
    for i, j, v in zip(r["i"], r["j"], r["v"]):
        omega[int(i[1]), int(j[1])] = omega[int(j[1]), int(i[1])] = v
    assert r["trace"] == pytest.approx((resid * omega).sum(), rel=1e-9)


def triangle(spark):
    return spark.createDataFrame([(D[0], *e) for e in ("ab", "bc", "ac", "cd")], "day date, i string, j string")


def test_network_statistics(spark):
    e = triangle(spark)
    days = spark.createDataFrame([(D[0],), (D[1],)], "day date")
    assert as_dict(nw.degree(e), "node") and {r["node"]: r["degree"] for r in nw.degree(e).collect()} == {
        "a": 2, "b": 2, "c": 3, "d": 1}
    assert {r["node"]: round(r["clustering"], 9) for r in nw.clustering(e).collect()} == {
        "a": 1.0, "b": 1.0, "c": round(1 / 3, 9), "d": 0.0}
    assert as_dict(nw.density(e, days, 4), "day") == {(D[0],): pytest.approx(4 / 6), (D[1],): 0.0}
    mean = as_dict(nw.degree_summary(e, days, 4), "day")
    assert mean[D[0],] == (2.0, pytest.approx(math.sqrt(0.5))) and mean[D[1],] == (0.0, 0.0)


def test_pagerank_against_power_iteration(spark):
    a = np.zeros((4, 4))
    for x, y in ((0, 1), (1, 2), (0, 2), (2, 3)):
        a[x, y] = a[y, x] = 1
    rank = np.full(4, 0.25)
    for _ in range(20):
        rank = 0.15 / 4 + 0.85 * a @ (rank / a.sum(1))
    got = {r["node"]: r["rank"] for r in nw.pagerank(triangle(spark)).collect()}
    assert [got[n] for n in "abcd"] == pytest.approx(rank.tolist())
    assert sum(got.values()) == pytest.approx(1.0)


def test_rolling_network_against_dense_mean(spark):
    rng = np.random.default_rng(2)
    on = rng.random((12, 3)) < 0.5
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    e = spark.createDataFrame([(D[t], *pairs[k]) for t in range(12) for k in range(3) if on[t, k]],
                              "day date, i string, j string")
    days = spark.createDataFrame([(D[t],) for t in range(12)], "day date")
    abar = nw.rolling_network_mean(e, days, 4)
    got = as_dict(abar.select("t", "i", "j", "p"), "t", "i", "j")
    want = {(t, *pairs[k]): on[t - 3:t + 1, k].mean() for t in range(3, 12) for k in range(3) if on[t - 3:t + 1, k].any()}
    assert got == pytest.approx(want)
    last = {(r["i"], r["j"]) for r in nw.network_mask(abar, 0.5, use_last_day=True).collect()}
    assert last == {pairs[k] for k in range(3) if on[8:12, k].mean() >= 0.5}
    early = as_dict(nw.network_mask(abar, 0.0, before=6), "i", "j")
    for k, pair in enumerate(pairs):
        mean = np.mean([on[t - 3:t + 1, k].mean() for t in range(3, 6)])
        assert early.get(pair, 0.0) == pytest.approx(mean)


def test_weights_from_precision_and_gmvp_agree(spark):
    rows = [(D[0], "x", "x", 1.0), (D[0], "x", "y", 0.0), (D[0], "y", "y", 3.0)]
    cov = spark.createDataFrame(rows, "day date, i string, j string, v double")
    assert as_dict(pf.gmvp(cov), "day", "asset") == {(D[0], "x"): pytest.approx(0.75), (D[0], "y"): pytest.approx(0.25)}
    prec = cv.precision_cells(cv.glasso(cov, [0.0]))
    assert as_dict(pf.w_from_prec(prec), "day", "asset") == {
        (D[0], "x"): pytest.approx(0.75), (D[0], "y"): pytest.approx(0.25)}


def test_shrinkage_against_numpy(spark):
    rets, x = returns(spark, 4, 9, 5, seed=7)
    got = as_dict(pf.shrunk_cov(rets, cv.realized_cov(rets), 3).select("day", "i", "j", "v"), "day", "i", "j")
    assert {k[0] for k in got} == {D[3], D[4]}
    for d in (3, 4):
        z = x[d - 3:d].reshape(-1, 4)
        n, s = len(z), z.T @ z / len(z)
        mu = np.trace(s) / 4
        far = ((s - mu * np.eye(4)) ** 2).sum()
        noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n ** 2, far)
        want = noise / far * mu * np.eye(4) + (1 - noise / far) * s
        for i in range(4):
            for j in range(i, 4):
                assert got[D[d], f"a{i}", f"a{j}"] == pytest.approx(want[i, j], abs=1e-15)


def test_renormalise(spark):
    rows = [("m", D[0], "a", 2.0), ("m", D[0], "b", 2.0), ("m", D[1], "a", 1.0), ("m", D[1], "b", -1.0)]
    pred = spark.createDataFrame(rows, "model string, day date, asset string, w_hat double")
    got = as_dict(pf.renormalise(pred), "model", "day", "asset")
    assert [got["m", D[0], a] for a in "ab"] == [0.5, 0.5] and [got["m", D[1], a] for a in "ab"] == [1.0, -1.0]


def test_box_keeps_the_total(spark):
    rng = np.random.default_rng(3)
    w = rng.dirichlet(np.full(30, 0.3), 4)
    pred = spark.createDataFrame([("m", D[d], f"a{i:02d}", float(w[d, i])) for d in range(4) for i in range(30)],
                                 "model string, day date, asset string, w_hat double")
    out = pf.box(pred, 0.05, 10).groupBy("day").agg(F.sum("w_hat").alias("s"), F.max("w_hat").alias("m")).collect()
    assert all(r["s"] == pytest.approx(1.0) and r["m"] <= 0.05 + 1e-12 for r in out)


def dfl_inputs(spark, days=6, k=3, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"a{i}" for i in range(k)]
    stat, before = rng.dirichlet(np.ones(k), days), rng.dirichlet(np.ones(k), days)
    covs = [(lambda z: z @ z.T)(rng.standard_normal((k, 8))) for _ in range(days)]
    pred = spark.createDataFrame([("m", D[d], names[i], float(stat[d, i])) for d in range(days) for i in range(k)],
                                 "model string, day date, asset string, w_hat double")
    held = spark.createDataFrame([(D[d], names[i], float(before[d, i])) for d in range(days) for i in range(k)],
                                 "day date, asset string, w_before double")
    cov = spark.createDataFrame([(D[d], names[i], names[j], float(covs[d][i, j])) for d in range(days)
                                 for i in range(k) for j in range(i, k)], "day date, i string, j string, v double")
    return pred, held, cov, stat, before, covs


def test_decision_focused_limits_and_optimality(spark):
    pred, held, cov, stat, before, covs = dfl_inputs(spark)
    far = as_dict(pf.decision_focused(pred, cov, held, 3e7, 1e7).drop("model"), "day", "asset")
    near = as_dict(pf.decision_focused(pred, cov, held, 0.3, 0.7).drop("model"), "day", "asset")
    for d in range(6):
        blend = 0.75 * before[d] + 0.25 * stat[d]
        assert [far[D[d], f"a{i}"] for i in range(3)] == pytest.approx(blend.tolist(), abs=1e-5)
        w = np.array([near[D[d], f"a{i}"] for i in range(3)])
        assert w.sum() == pytest.approx(1.0)
        grad = covs[d] @ w + w - 0.3 * before[d] - 0.7 * stat[d]
        assert np.ptp(grad) == pytest.approx(0.0, abs=1e-9)  # equal up to the multiplier


def test_decision_focused_per_asset_eta(spark):
    pred, held, cov, stat, before, covs = dfl_inputs(spark, days=2)
    held = held.withColumn("eta", F.when(F.col("asset") == "a0", 2.0).otherwise(0.1))
    got = as_dict(pf.decision_focused(pred, cov, held, 0.0, 0.5).drop("model"), "day", "asset")
    eta = np.array([2.0, 0.1, 0.1])
    for d in range(2):
        w = np.array([got[D[d], f"a{i}"] for i in range(3)])
        assert np.ptp(covs[d] @ w + (eta + 0.5) * w - eta * before[d] - 0.5 * stat[d]) == pytest.approx(0.0, abs=1e-9)


def test_decision_focused_own_recursion(spark):
    pred, _, cov, stat, _, covs = dfl_inputs(spark, days=6)
    got = as_dict(pf.decision_focused_own(pred, cov, 0.3, 0.7, lim=10.0).drop("model"), "day", "asset")
    w = stat[0]
    for d in range(6):
        a = covs[d] + np.eye(3)
        x, u = np.linalg.solve(a, 0.3 * w + 0.7 * stat[d]), np.linalg.solve(a, np.ones(3))
        w = x + u * (1 - x.sum()) / u.sum()
        assert [got[D[d], f"a{i}"] for i in range(3)] == pytest.approx(w.tolist())


def test_turnover_drawdown_and_returns(spark):
    pred = panel(spark, {"a": [1, 0, 0], "b": [0, 1, 1]}, "w_hat").withColumn("model", F.lit("m"))
    assert ev.turnover_seq(pred).first()["turnover_seq"] == 1.0
    port = spark.createDataFrame([("m", D[k], v) for k, v in enumerate((0.1, -0.2, 0.05))],
                                 "model string, day date, ret double")
    assert [round(r["cum"], 9) for r in ev.cumulative(port).orderBy("day").collect()] == [0.1, -0.1, -0.05]
    assert ev.max_drawdown(port).first()["max_drawdown"] == pytest.approx(-0.2)
    assert ev.max_drawdown(port, compound=True).first()["max_drawdown"] == pytest.approx(-0.2)
    assert ev.volatility(port).first()["volatility"] == pytest.approx(np.std([0.1, -0.2, 0.05], ddof=1) * 252 ** 0.5)


@pytest.mark.parametrize("z,want", [(-40.01477052196851, -349.39277), (-41.26726539381883, -371.51289),
                                    (-37.51807652527744, -307.33038)])
def test_log_p_beyond_underflow(spark, z, want):
    got = spark.range(1).select(log10_normal_tail(F.lit(z)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-4)


def test_log_p_in_the_ordinary_range(spark):
    zs = [0.0, 0.1, 1.0, 1.959963984540054, 2.9999, 3.0001, 5.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", log10_normal_tail(F.col("z")).alias("p"))
    for r in df.collect():
        assert 10 ** r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-9)


def test_dm_statistic_with_and_without_lags(spark):
    rng = np.random.default_rng(8)
    base, other = rng.random(40), rng.random(40)
    losses = spark.createDataFrame([(m, D[k], float(v)) for m, vs in (("base", base), ("x", other))
                                    for k, v in enumerate(vs)], "model string, day date, loss double")
    d = other - base
    c = d - d.mean()
    var = (c * c).mean()
    assert ev.dm_test(losses, "base").first()["dm_stat"] == pytest.approx(d.mean() / math.sqrt(var / 40))
    for lag in (1, 2, 3):
        var += 2 * (1 - lag / 4) * (c[lag:] * c[:-lag]).sum() / 40
    assert ev.dm_test(losses, "base", lags=3).first()["dm_stat"] == pytest.approx(d.mean() / math.sqrt(var / 40))


def integer(k, seed):
    m = 2147483647
    u = (k * 48271 + seed) % m
    u = (u * u + u) % m
    return (u * 69621 + 12345) % m


def test_bootstrap_and_confidence_set_against_plain_python(spark):
    rng = np.random.default_rng(9)
    n, reps, block = 23, 60, 5
    loss = {"a": rng.random(n), "b": rng.random(n) + 0.1, "c": rng.random(n) + 0.8}
    df = spark.createDataFrame([(m, D[k], float(v)) for m, vs in loss.items() for k, v in enumerate(vs)],
                               "model string, day date, loss double")
    n_blocks = -(-n // block)
    draws = [[(integer(r * n_blocks + b + 1, 3) % n + o) % n for b in range(n_blocks) for o in range(block)][:n]
             for r in range(reps)]
    sim = np.array([[loss[m][t].mean() for m in "abc"] for t in draws])
    got = as_dict(bootstrap_means(df, reps, block, 3), "rep", "model")
    for r in range(reps):
        assert [got[r, m] for m in "abc"] == pytest.approx(sim[r].tolist())

    real = np.array([loss[m].mean() for m in "abc"])
    left, p, want = [0, 1, 2], 0.0, {}
    while len(left) > 1:
        d = real[left] - real[left].mean()
        boot = sim[:, left] - sim[:, left].mean(1, keepdims=True) - d
        t = d / np.sqrt((boot ** 2).mean(0))
        p = max(p, np.mean([max(row / np.sqrt((boot ** 2).mean(0))) >= t.max() for row in boot]))
        want["abc"[left.pop(int(t.argmax()))]] = p
    want["abc"[left[0]]] = 1.0
    out = {r["model"]: r["mcs_p"] for r in mcs(df, reps, block, 3).collect()}
    assert out == pytest.approx(want)


def test_confidence_set_of_identical_models(spark):
    losses = spark.createDataFrame([(m, D[k], 0.1 * (k % 7)) for m in "ab" for k in range(20)],
                                   "model string, day date, loss double")
    assert {r["model"]: r["mcs_p"] for r in mcs(losses, 50).collect()} == {"a": 1.0, "b": 1.0}


def test_sequences_end_at_the_target_row(spark):
    x = spark.createDataFrame([(t, D[t], [float(t), 10.0 * t]) for t in range(5)], "t int, day date, x array<double>")
    got = {r["t"]: r["seq"] for r in ft.make_sequences(x, x.select("t"), 3).collect()}
    assert sorted(got) == [2, 3, 4] and got[3] == [[1.0, 10.0], [2.0, 20.0], [3.0, 30.0]]


def test_scaler_floor_and_population_sd(spark):
    long = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0)], "pos int, v double")
    assert as_dict(ft.fit_scaler(long), "pos") == {(1,): (2.0, 1.0), (2,): (5.0, 1e-8)}


def test_exog_join_has_no_look_ahead(spark):
    days = spark.createDataFrame([(D[k],) for k in range(5)], "day date")
    series = spark.createDataFrame([(D[0], "x", 1.0), (D[2], "x", 3.0)], "day date, name string, x double")
    assert [r["x"] for r in ft.join_exog(days, series).orderBy("day").collect()] == [None, 1.0, 1.0, 3.0, 3.0]
    assert [r["x"] for r in ft.join_exog(days, series, lag=0).orderBy("day").collect()] == [1.0, 1.0, 3.0, 3.0, 3.0]


def test_day_checks(spark):
    df = spark.createDataFrame([(D[k],) for k in (0, 1, 3, 4)], "day date")
    assert [r["day"] for r in q.check_days(df).collect()] == [D[2]]
    assert q.day_count(df, 5).first()["missing"] == 1
    assert [r["part"] for r in q.split_time(df, 0.5, 0.75).orderBy("day").collect()] == [
        "train", "train", "validation", "test"]


def test_missing_counts(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("-inf"),)], "ret double")
    assert tuple(q.check_missing(df, "ret").first()) == (4, 1, 1, 1)


def test_type_check_raises_before_any_job(spark):
    want = T.StructType([T.StructField("ret", T.DoubleType())])
    q.check_types(spark.createDataFrame([(1.0,)], "ret double"), want)
    with pytest.raises(TypeError, match="ret"):
        q.check_types(spark.createDataFrame([(1.0,)], "ret float"), want)


def test_daily_files_with_spaces_in_their_names(spark, tmp_path):
    (tmp_path / "2008 01 02_1min_log_return.csv").write_text("A,0.1,-0.2,0.3\nB,1e-3,0,2\n")
    (tmp_path / "2008 01 03_1min_log_return.csv").write_text("A,0.5\n")
    got = as_dict(files.read_returns(spark, str(tmp_path)), "day", "bar", "asset")
    day = dt.date(2008, 1, 2)
    assert got[day, 1, "A"] == -0.2 and got[day, 0, "B"] == 1e-3 and got[dt.date(2008, 1, 3), 0, "A"] == 0.5
    assert len(got) == 7


def test_cache_prunes_years(spark):
    rets, _ = returns(spark, 2, 3, 4)
    path = scratch_path(spark, "cache")
    files.cache_returns(rets, path)
    assert read_rows(files.read_cached_returns(spark, path)) == read_rows(rets)
    part = files.read_cached_returns(spark, path, "2024-01-02", "2024-01-03")
    assert {r["day"] for r in part.collect()} == {D[1], D[2]}
    assert "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().toString()


def read_rows(df):
    return sorted(map(tuple, df.select("day", "bar", "asset", "ret").collect()))


def test_store_filters_reach_the_scan(spark):
    path = scratch_path(spark, "edges")
    files.write_edges(triangle(spark), path)
    one = files.read_edges(spark, path, "2024-01-01")
    assert one.count() == 4
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(day)" in plan


def test_parameter_set(spark, tmp_path):
    path = tmp_path / "params.json"
    path.write_text('{\n "P_LAGS": 3,\n "LAMBDA_EXOG": 0.0005,\n "USE_LAST_DAY": false,\n'
                    ' "mean_val_mse": {"M2": 1.5e-05, "M3": 1.25e-05},\n "mean_network_density": 0.25\n}')
    row = files.read_params(spark, str(path)).first()
    assert row["P_LAGS"] == 3 and row["USE_LAST_DAY"] is False and row["mean_val_mse"] == {"M2": 1.5e-5, "M3": 1.25e-5}
    assert row["NETWORK_THRESHOLD"] is None
    assert as_dict(files.params_long(files.read_params(spark, str(path))), "metric", "model") == {
        ("mean_val_mse", "M2"): 1.5e-5, ("mean_val_mse", "M3"): 1.25e-5}


def test_columns(spark):
    df = spark.createDataFrame([(1, -1000.0), (1, 0.0), (2, 3.0)], "g int, x double")
    got = [r["s"] for r in df.select(sigmoid(F.col("x")).alias("s")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(50)), 0.5, 1 / (1 + math.exp(-3))])
    soft = [r["s"] for r in df.orderBy("g", "x").select("g", "x", softmax(F.col("x"), 0.5, "g").alias("s")).orderBy("g", "x").collect()]
    assert soft == pytest.approx([0.0, 1.0, 1.0])
    assert spark.range(5).select(mixed_integer(F.col("id"), 3).alias("u")).collect() == [(integer(k, 3),) for k in range(5)]


def test_describe_weights_moments(spark):
    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, size=50)
    got = {r["statistic"]: r["value"] for r in ev.describe_weights(
        spark.createDataFrame([(D[0], f"a{k}", float(x)) for k, x in enumerate(v)], "day date, asset string, w double")).collect()}
    z = (v - v.mean()) / v.std()
    assert got["skewness"] == pytest.approx((z ** 3).mean()) and got["kurtosis"] == pytest.approx((z ** 4).mean())
    assert got["p50"] == pytest.approx(np.median(v)) and got["sd"] == pytest.approx(pd.Series(v).std())


def test_published_sensitivity_counts(spark):
    """Configurations beating a baseline are counted per value of one parameter."""
    grid = spark.createDataFrame([(l, 1.0 + 0.1 * k + l) for l in (0.0, 1.0) for k in range(4)],
                                 "LAMBDA_LASSO double, mean_val_mse double")
    got = as_dict(ev.sensitivity(grid, "LAMBDA_LASSO", 1.15).select("LAMBDA_LASSO", "n_configs", "n_better"), "LAMBDA_LASSO")
    assert got == {(0.0,): (4, 2), (1.0,): (4, 0)}


def test_lambda_selection_and_scan_against_numpy(spark):
    from panelweave.functions.kernels import sparse_precision

    rets, x = returns(spark, 4, 30, 12, seed=12)
    cov = cv.realized_cov(rets)
    lams = [1e-4, 1e-3, 4e-3]
    s = np.stack([d.T @ d for d in x])
    weights = {l: (lambda o: o.sum(1) / o.sum())(sparse_precision(s[:6].mean(0), l)[0]) for l in lams}
    score = {l: np.mean([w @ m @ w for m in s[6:9]]) for l, w in weights.items()}
    got = pn.select_lambda(cov, lams, train=6, valid=3, test=2).first()
    assert got["lambda"] == min(score, key=lambda lam: (round(score[lam], 12), -lam)) and got["score"] == pytest.approx(min(score.values()), rel=1e-6)
    scan = {r["lambda"]: r for r in pn.lambda_scan(cv.glasso(cov, lams), cov, 4).collect()}
    for l in lams:
        om = [sparse_precision(m, l)[0] for m in s]
        w = [o.sum(1) / o.sum() for o in om]
        assert scan[l]["oos_variance"] == pytest.approx(np.mean([w[d] @ s[d + 1] @ w[d] for d in range(11)]), rel=1e-5)
        assert scan[l]["density"] == pytest.approx(np.mean([(np.count_nonzero(o) - 4) / 12 for o in om]))
    assert scan[1e-4]["density"] > scan[4e-3]["density"]


def test_vanishing_denominators_give_null(spark):
    losses = spark.createDataFrame([(m, D[k], 0.5) for m in ("a", "b") for k in range(4)],
                                   "model string, day date, loss double")
    row = ev.dm_test(losses, "a").first()
    assert row["dm_stat"] is None and row["dm_log10_p"] is None
    port = losses.withColumnRenamed("loss", "ret")
    flat = ev.sharpe(port, port.select("model", "day", F.lit(0.0).alias("turnover")))
    assert {r["sharpe"] for r in flat.collect()} == {None}


def test_network_mask_counts_days_without_links(spark):
    from panelweave.operators import network as nw
    days = spark.sql("SELECT date_add(DATE '2020-01-01', CAST(id AS INT)) AS day, CAST(id AS INT) AS t FROM range(10)")
    edges = days.filter("t < 2").selectExpr("day", "'a' AS i", "'b' AS j")
    abar = nw.rolling_network_mean(edges, days, window=2)
    calendar = days.filter("t >= 1")
    p = nw.network_mask(abar, 0.0, calendar=calendar).first()["p"]
    assert abs(p - 1.5 / 9) < 1e-12
    assert nw.network_mask(abar, 0.0, True, calendar=calendar).count() == 0


def test_shape_sees_a_doubled_cell_beside_a_hole(spark):
    from panelweave.operators import quality as q
    rows = [("2020-01-01", a, b) for a, b in (("a", 0), ("b", 0), ("a", 1), ("a", 1))]
    df = spark.createDataFrame(rows, "day string, asset string, bar int")
    assert [r["ok"] for r in q.check_shape(df, 2, 2).collect()] == [False]


def test_lags_follow_the_calendar(spark):
    from panelweave.operators import features as ft
    rows = [(d, a, float(d * 10 + (a == "y"))) for d in range(4) for a in "xy" if (d, a) != (1, "y")]
    df = spark.createDataFrame(rows, "d int, asset string, w double").selectExpr(
        "date_add(DATE '2020-01-01', d) AS day", "asset", "w")
    got = {(r["t"], r["name"], r["lag"]): r["v"] for r in ft.lag_features(df, 2).collect()}
    assert got[2, "y", 1] is None and got[2, "y", 2] == 1.0
    assert got[3, "y", 1] == 21.0 and got[3, "y", 2] is None and got[3, "x", 2] == 10.0


def test_bootstrap_uses_common_days(spark):
    from panelweave.operators.confidence_set import bootstrap_means
    rows = [(m, f"2020-01-{d:02d}", 1.0) for m in "ab" for d in range(1, 11) if m == "a" or d < 9]
    got = bootstrap_means(spark.createDataFrame(rows, "model string, day string, loss double"), reps=20).collect()
    assert len(got) == 40 and all(abs(r["mean_loss"] - 1) < 1e-12 for r in got)


def test_box_that_cannot_hold_stops(spark):
    from panelweave.operators import portfolio as pf
    df = spark.createDataFrame([("m", 1, a, 0.2) for a in "abcde"], "model string, day int, asset string, w_hat double")
    with pytest.raises(Exception, match="cannot add up to 1"):
        pf.box(df).collect()
    assert abs(sum(r["w_hat"] for r in pf.box(df, 0.3).collect()) - 1) < 1e-12


def test_incomplete_days_get_no_forecast(spark):
    from panelweave.operators.fit import predict
    long = spark.createDataFrame([(0, t, t, p, v) for t, p, v in ((1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (3, 1, 1.0), (3, 2, None))],
                                 "fold int, t int, day int, pos int, v double")
    coefs = spark.createDataFrame([("m", 1, 0, "a", 0, 0.1), ("m", 1, 0, "a", 1, 0.2), ("m", 1, 0, "a", 2, 0.2)],
                                  "model string, config_id int, fold int, asset string, pos int, beta double")
    assert [(r["t"], round(r["w_hat"], 9)) for r in predict(long, coefs, normalise=False).collect()] == [(1, 0.7)]


def test_comparison_keeps_models_without_a_metric(spark):
    from panelweave.operators import evaluate as ev
    a = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "model string, mse double")
    b = spark.createDataFrame([("n", 0.5)], "model string, dm double")
    assert {(r["model"], r["dm"]) for r in ev.compare(a, b).collect()} == {("m", None), ("n", 0.5)}


def test_malformed_return_files_are_read_as_nulls(spark, tmp_path):
    from panelweave.sources.files import read_returns
    (tmp_path / "2020_01_02_1min_log_return.csv").write_text("a,0.1,bad\nb\n")
    (tmp_path / "9999_99_99_1min_log_return.csv").write_text("a,0.3\n")
    got = {(str(r["day"]), r["asset"], r["bar"], r["ret"]) for r in read_returns(spark, str(tmp_path)).collect()}
    assert got == {("2020-01-02", "a", 0, 0.1), ("2020-01-02", "a", 1, None), ("2020-01-02", "b", None, None), ("None", "a", 0, 0.3)}


def test_network_mask_keeps_a_mean_equal_to_tau(spark):
    from panelweave.operators import network as nw
    # 200 pairs with 390 links in 65 windows of 20: 0.3, however the sum of the shares would round
    rng = np.random.default_rng(1)
    shares = [[int(n) for n in rng.permutation([5, 7] * 32 + [6])] for _ in range(200)]
    rows = [(t, f"a{k}", "b", n / 20, n, 20) for k, row in enumerate(shares) for t, n in enumerate(row) if n]
    abar = spark.createDataFrame(rows, "t int, i string, j string, p double, n_linked long, n_window int")
    assert any(np.cumsum([n / 20 for n in row])[-1] / 65 < 0.3 for row in shares)
    got = nw.network_mask(abar, 0.3, calendar=spark.range(65).selectExpr("CAST(id AS INT) AS t")).collect()
    assert {r["i"] for r in got} == {f"a{k}" for k in range(200)} and {r["p"] for r in got} == {0.3}


def test_solve_report_and_its_sql_on_small_variances(spark, tmp_path):
    import duckdb
    from panelweave.plans import all_oracles, all_queries
    # February has daily changes of about 0.01, April of about 1; both hold twins
    lines = [(f"2020-{m:02d}-{d:02d}", s, 1000.0 * (1 + ((7 * d + 5 * k) % 11) * (2 if m == 4 else 1e-3)))
             for m, last in ((2, 29), (3, 31), (4, 30)) for d in range(1, last + 1) for k, s in enumerate("FO")]
    spark.createDataFrame(lines, "day string, l_linestatus string, l_extendedprice double").selectExpr(
        "CAST(day AS timestamp) AS l_shipdate", "l_linestatus", "l_extendedprice", "CAST(0 AS double) AS l_discount"
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in all_queries()["c16_solve_report"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(all_oracles()["c16_solve_report"]).fetchall())
    assert [r[2] for r in got] == [0, 0, 1]
