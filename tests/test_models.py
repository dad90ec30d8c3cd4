"""Fits: optimality on raw data, nesting identities, monotonicity, no look-ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import features as ft
from panelweave.operators import fit as fm
from panelweave.sources.scratch import stage

K, P, EX, T = 4, 2, 3, 160
CUTS, H = [90, 120], 25
LAYOUT = fm.Layout(K, P, EX)
D0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    """A panel with dynamics, its design in Spark and in NumPy."""
    rng = np.random.default_rng(11)
    w = np.zeros((T, K))
    w[0] = 1 / K
    for t in range(1, T):
        w[t] = 0.1 + 0.5 * w[t - 1] + 0.1 * np.roll(w[t - 1], 1) + 0.02 * rng.standard_normal(K)
    ex = rng.standard_normal((T, EX))
    days = [D0 + dt.timedelta(days=t) for t in range(T)]
    names = [f"a{i}" for i in range(K)]
    weights = spark.createDataFrame([(days[t], names[i], float(w[t, i])) for t in range(T) for i in range(K)],
                                    "day date, asset string, w double")
    exog = spark.createDataFrame([(days[t], f"e{j}", float(ex[t, j])) for t in range(T) for j in range(EX)],
                                 "day date, name string, x double")
    lags = ft.lag_features(weights, P)
    pos = ft.feature_names(lags, exog)
    long = stage(ft.positioned(lags, exog, pos), "design")
    rows = stage(fm.design(ft.assemble(long, LAYOUT.p),
                           ft.target_arrays(ft.align_targets(long, weights, P))), "rows")
    eq = spark.createDataFrame(list(enumerate(names)), "equation int, asset string")
    x = np.column_stack([w[P - 1:T - 1], w[P - 2:T - 2], ex[P:]])
    links = spark.createDataFrame([(f, i, j, 1.0) for f in range(2) for i in range(K) for j in range(i + 1, K)],
                                  "fold int, i int, j int, p double")
    return {"weights": weights, "long": long, "rows": rows, "eq": eq, "x": x, "y": w[P:], "names": pos, "links": links,
            "mom": stage(fm.moments(rows, CUTS), "moments")}


def betas(fitted):
    out = {}
    for r in fitted.collect():
        b = np.zeros(LAYOUT.p)
        b[np.array(r["pos"], dtype=int) - 1] = r["beta"]
        out[r["config_id"], r["fold"], r["equation"]] = (r["intercept"], b)
    return out


def test_positions_follow_the_rule(world):
    got = [(r["kind"], r["lag"], r["name"]) for r in world["names"].orderBy("pos").collect()]
    assert got == ([("lag", l, f"a{i}") for l in (1, 2) for i in range(K)] + [("exog", 0, f"e{j}") for j in range(EX)])


def test_moments_against_numpy(world):
    cells = {(r["fold"], r["kind"], r["i"], r["j"]): r["v"] for r in world["mom"].collect()}
    for fold, cut in enumerate(CUTS):
        n = cut - P
        z = np.column_stack([np.ones(n), world["x"][:n], world["y"][:n]])
        g = z.T @ z
        for i in range(len(g)):
            for j in range(i, len(g)):
                assert cells[fold, "z", i, j] == pytest.approx(g[i, j], rel=1e-12)
        d = np.diff(world["x"][:n], axis=0)
        assert cells[fold, "d", 0, LAYOUT.p - 1] == pytest.approx((d.T @ d)[0, -1], rel=1e-10)


def test_ols_against_numpy(world):
    got = betas(fm.fit(world["mom"], [fm.Config("M1", 0, lam_exog=0.0, kind="ols")], LAYOUT, block=3))
    for fold, cut in enumerate(CUTS):
        n = cut - P
        z = np.column_stack([np.ones(n), world["x"][:n]])
        want = np.linalg.lstsq(z, world["y"][:n], rcond=None)[0]
        for e in range(K):
            icept, b = got[0, fold, e]
            assert icept == pytest.approx(want[0, e], rel=1e-6) and b == pytest.approx(want[1:, e], rel=1e-5, abs=1e-8)


def conditions(world, fold, e, icept, b, pen, smooth=0.0):
    """Largest breach of the lasso conditions, computed from the raw rows."""
    n = CUTS[fold] - P
    x, y = world["x"][:n], world["y"][:n, e]
    sd = x.std(0)
    resid = y - icept - x @ b
    d = np.diff(x, axis=0)
    g = (x - x.mean(0)).T @ resid / n / sd - smooth * (d.T @ (d @ b)) / n / sd
    on = b != 0
    return max(np.abs(g - pen * np.sign(b))[on].max(initial=0), (np.abs(g) - pen)[~on].max(initial=0), abs(resid.mean()))


def test_lasso_conditions_on_raw_rows(world):
    configs = [fm.Config("M3", 1, lam=2e-3, lam_exog=1e-3), fm.Config("M3", 2, lam=5e-3, lam_exog=1e-3),
               fm.Config("M3a", 3, lam=2e-3, lam_exog=1e-3, self_free=True),
               fm.Config("M4", 4, lam=1e-3, lam_exog=1e-3, lam_net=4e-3, tau=0.7, self_free=True),
               fm.Config("M5", 5, lam=1e-3, lam_exog=1e-3, lam_net=4e-3, tau=0.7, self_free=True, lam_smooth=0.5)]
    links = world["links"].filter("(i = 0 and j = 1) or (i = 2 and j = 3)")
    fitted = fm.fit(world["mom"], configs, LAYOUT, links, block=3)
    by = {c.config_id: c for c in configs}
    linked = {(0, 1), (1, 0), (2, 3), (3, 2)}
    got = betas(fitted)
    assert len(got) == 5 * 2 * K
    for (cid, fold, e), (icept, b) in got.items():
        c = by[cid]
        pen = np.full(LAYOUT.p, c.lam_exog)
        for j in range(P * K):
            i = j % K
            pen[j] = c.lam + (c.lam_net if c.tau is not None and i != e and (i, e) not in linked else 0)
            if c.self_free and i == e:
                pen[j] = 0.0
        assert conditions(world, fold, e, icept, b, pen, c.lam_smooth) < 1e-8
    counts = {cid: sum((b != 0).sum() for (k, _, _), (_, b) in got.items() if k == cid) for cid in (1, 2)}
    assert counts[1] > counts[2]


def test_last_day_networks_beside_means(world):
    """Both variants in one call; each equals a single fit with its mask, and they differ."""
    mean = world["links"].filter("(i = 0 and j = 1) or (i = 2 and j = 3)")
    last = mean.filter("i = 0").withColumn("p", F.lit(0.9)).unionAll(
        mean.filter("i = 0").withColumn("i", F.lit(1)).withColumn("j", F.lit(2)).withColumn("p", F.lit(0.9)))
    both = mean.withColumn("variant", F.lit("mean")).unionAll(last.withColumn("variant", F.lit("last")))
    spec = {"lam": 1e-3, "lam_exog": 1e-3, "lam_net": 4e-3, "tau": 0.7, "self_free": True}
    one, two = fm.Config("M4", 1, **spec), fm.Config("M4", 2, **spec, use_last_day=True)
    got = fm.fit(world["mom"], [one, two], LAYOUT, both, block=3)
    same(got.filter("config_id = 1"), fm.fit(world["mom"], [one], LAYOUT, mean, block=3))
    same(got.filter("config_id = 2"), fm.fit(world["mom"], [fm.Config("M4", 2, **spec)], LAYOUT, last, block=3))
    a, b = betas(got.filter("config_id = 1")), betas(got.filter("config_id = 2"))
    assert max(np.abs(a[1, f, e][1] - b[2, f, e][1]).max() for _, f, e in a) > 1e-6
    with pytest.raises(ValueError, match="last day"):
        fm.fit(world["mom"], [two], LAYOUT, mean)


def test_least_squares_of_all_equations_at_once(world):
    """The plain fit is factored once per fold; a mixture of kinds keeps every row, in blocks or not."""
    configs = [fm.Config("M1", 0, kind="ols"), fm.Config("M2", 1, lam=2e-3), fm.Config("M2", 2, lam=4e-3)]
    mixed = fm.fit(world["mom"], configs, LAYOUT, block=2)
    assert mixed.count() == 3 * 2 * K
    same(mixed.filter("config_id = 0"), fm.fit(world["mom"], configs[:1], LAYOUT))
    same(mixed.filter("config_id = 2"), fm.fit(world["mom"], configs[2:], LAYOUT))


def test_forecasts_are_blocked_products(spark):
    """Several blocks of rows and runs, against NumPy; days with a gap or a null get none."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 4))
    day = dt.date(2001, 1, 1)
    long = [(f, t, day + dt.timedelta(t), j + 1, float(x[t, j])) for f in (0, 1) for t in range(1200) for j in range(4)
            if (t, j) != (7, 2)]
    long = [(f, t, d, j, None if t == 9 and j == 1 else v) for f, t, d, j, v in long]
    beta = {(m, c, f, a): rng.standard_normal(5) * (rng.random(5) < 0.6) + (np.arange(5) == 0)
            for m, c in (("A", 1), ("A", 2), ("B", 1)) for f in (0, 1) for a in ("x", "y", "z")}
    rows = spark.createDataFrame(long, "fold int, t int, day date, pos int, v double")
    coefs = spark.createDataFrame([(*key, j, float(b[j])) for key, b in beta.items() for j in range(5) if b[j] or j == 0],
                                  "model string, config_id int, fold int, asset string, pos int, beta double")
    for normalise in (False, True):
        got = fm.predict(rows, coefs, normalise).toPandas().set_index(["model", "config_id", "fold", "asset", "t"])["w_hat"]
        assert len(got) == 18 * 1198 and got.index.is_unique
        for m, c in (("A", 1), ("A", 2), ("B", 1)):
            for f in (0, 1):
                raw = {a: beta[m, c, f, a][0] + x @ beta[m, c, f, a][1:] for a in "xyz"}
                total = sum(raw.values()) if normalise else 1.0
                for a in "xyz":
                    own = got[m, c, f, a]
                    assert np.allclose(own.to_numpy(), (raw[a] / total)[own.index], rtol=1e-7)
    assert fm.predict(rows, coefs.filter("false")).count() == 0


def same(a, b):
    a, b = betas(a), betas(b)
    for (_, fold, e), (icept, beta) in a.items():
        other = next(v for (_, f, q), v in b.items() if (f, q) == (fold, e))
        assert icept == pytest.approx(other[0], abs=1e-9) and beta == pytest.approx(other[1], abs=1e-8)


def test_nesting_identities(world):
    mom, links = world["mom"], world["links"]
    m2 = fm.fit(mom, [fm.Config("M2", 0, lam=2e-3)], LAYOUT)
    m3 = fm.fit(mom, [fm.Config("M3", 0, lam=2e-3, lam_exog=1e6)], LAYOUT)
    same(m2, m3)
    m3a = fm.fit(mom, [fm.Config("M3a", 0, lam=2e-3, lam_exog=1e-3, self_free=True)], LAYOUT)
    full = fm.fit(mom, [fm.Config("M4", 0, lam=2e-3, lam_exog=1e-3, lam_net=1.0, tau=0.7, self_free=True)], LAYOUT, links)
    free = fm.fit(mom, [fm.Config("M4", 0, lam=2e-3, lam_exog=1e-3, lam_net=0.0, tau=0.7, self_free=True)], LAYOUT,
                  links.limit(0))
    plain = fm.fit(mom, [fm.Config("M5", 0, lam=2e-3, lam_exog=1e-3, self_free=True, lam_smooth=0.0)], LAYOUT)
    for other in (full, free, plain):
        same(m3a, other)


def test_smoothing_lowers_turnover_and_grid_ranks(world):
    configs = [fm.Config("M5", n, lam=1e-4, lam_exog=1e-4, self_free=True, lam_smooth=s)
               for n, s in enumerate((0.0, 0.5, 5.0))]
    grid = fm.grid_search(world["rows"], world["long"], world["weights"], world["eq"], configs, LAYOUT, CUTS, H,
                          world["links"], stage)
    turn = [r["mean_turnover_seq"] for r in grid.orderBy("LAMBDA_TURNOVER").collect()]
    assert turn[0] > turn[1] > turn[2]


def test_predict_and_fold_scores_against_numpy(world):
    configs = [fm.Config("M3", 7, lam=2e-3, lam_exog=1e-3)]
    fitted = stage(fm.fit(world["mom"], configs, LAYOUT), "fits")
    rows = fm.validation_rows(world["long"], CUTS, H)
    pred = stage(fm.predict(rows, fm.coefficients(fitted, world["eq"])), "forecasts")
    got = {(r["fold"], r["t"], r["asset"]): r["w_hat"] for r in pred.collect()}
    b = betas(fitted)
    assert len(got) == 2 * H * K
    scores = {}
    for fold, cut in enumerate(CUTS):
        raw = np.array([[b[7, fold, e][0] + world["x"][t - P] @ b[7, fold, e][1] for e in range(K)]
                        for t in range(cut, cut + H)])
        w = raw / raw.sum(1, keepdims=True)
        for k in range(H):
            assert [got[fold, cut + k, f"a{e}"] for e in range(K)] == pytest.approx(w[k].tolist())
        y = world["y"][cut - P:cut - P + H]
        scores[fold] = (((w - y) ** 2).mean(), np.abs(np.diff(w, axis=0)).sum(1).mean())
    for r in fm.fold_metrics(pred, fitted, world["weights"], LAYOUT).collect():
        assert (r["val_mse"], r["turnover_seq"]) == pytest.approx(scores[r["fold"]])
        alive = sum((b[7, r["fold"], e][1] != 0).sum() for e in range(K))
        assert r["n_alive"] == alive and r["sparsity"] == pytest.approx(1 - alive / (K * LAYOUT.p))


def test_fits_do_not_see_validation_rows(world):
    changed = world["rows"].withColumn("y", F.when(F.col("t") >= CUTS[1], F.transform("y", lambda v: v * 100)).otherwise(F.col("y")))
    config = [fm.Config("M2", 0, lam=1e-3)]
    same(fm.fit(fm.moments(changed, CUTS), config, LAYOUT), fm.fit(world["mom"], config, LAYOUT))


def test_recurrent_scoring_matches_the_helper(spark):
    from panelweave.functions.kernels import recurrent_forward
    from panelweave.operators.recurrent import score_sequences
    from panelweave.plans.models import recurrent_parameters

    rng = np.random.default_rng(1)
    x = rng.standard_normal((9, 5, 3))
    df = spark.createDataFrame([(t, D0, x[t].tolist()) for t in range(9)], "t int, day date, seq array<array<double>>")
    par = recurrent_parameters(3, 4, 2)
    got = {(r["t"], r["asset"]): r["w_hat"] for r in score_sequences(df, par, ["a", "b"]).collect()}
    want = recurrent_forward(x, par["gates"], par["out"])
    assert [got[t, a] for t in range(9) for a in "ab"] == pytest.approx(want.ravel().tolist())


def test_model_selection_falls_back_and_drops(spark):
    grid = spark.createDataFrame(
        [("M3a", 0, 1.0, 0.2), ("M4", 1, 1.1, 0.2), ("M5", 2, 0.9, 0.9), ("M5", 3, 1.2, 0.1)],
        "model string, config_id int, mean_val_mse double, mean_turnover_seq double")
    free = {r["model"]: (r["config_id"], r["reason"]) for r in fm.select_models(grid).collect()}
    assert free["M4"] == (1, "dropped: does not beat M3a") and free["M5"][0] == 2
    tight = {r["model"]: (r["config_id"], r["reason"]) for r in fm.select_models(grid, max_turnover=0.5).collect()}
    assert tight["M5"] == (3, "within bounds")
    none = {r["model"]: (r["config_id"], r["reason"]) for r in fm.select_models(grid, max_turnover=0.01).collect()}
    assert none["M5"] == (2, "no config within bounds; lowest MSE")


def test_registered_backtest_runs_every_configuration(spark, sf_dir):
    from panelweave.plans import models as md

    rows = md.QUERIES["f13_backtest"](spark, sf_dir).collect()
    assert sorted((r["model"], r["config_id"], r["fold"]) for r in rows) == sorted(
        (c.model, c.config_id, f) for c in md.FULL for f in range(len(md.CUTS)))
    assert all((r["density"] is not None) == (r["model"] in ("M4", "M5")) for r in rows)
    assert all(np.isfinite(r["val_mse"]) for r in rows)


def test_registered_moments_cover_the_full_design(spark, sf_dir):
    from panelweave.plans import models as md

    w, long, _ = md.full_design(spark, sf_dir)
    rows = md.rows_of(w, long, md.LAGS, md.layout_of(6).p).toPandas().sort_values("t")
    x, y = np.stack(rows["x"]), np.stack(rows["y"])
    assert x.shape[1] == 3 * 6 + 8
    got = {(r["fold"], r["i"], r["j"]): r["v"] for r in md.QUERIES["f00_moments_full"](spark, sf_dir).filter("kind = 'z'").collect()}
    for fold, cut in enumerate(md.CUTS):
        z = np.column_stack([np.ones(len(x)), x, y])[rows["t"].to_numpy() < cut]
        want = z.T @ z
        assert all(got[fold, i, j] == pytest.approx(want[i, j], rel=1e-9, abs=2e-6) for i in range(len(want)) for j in range(i, len(want)))


def test_ranking_of_all_models_or_some(spark, sf_dir):
    from panelweave.plans import reports

    every = reports.QUERIES["h05_grid_ranking_all"](spark, sf_dir).collect()
    assert "M5" in {r["model"] for r in every} and [r["place"] for r in every] == list(range(1, len(every) + 1))
    some = reports.ranking(spark, sf_dir, ["M4", "M5"]).collect()
    assert {r["model"] for r in some} == {"M4", "M5"}
