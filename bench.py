"""Headline queries on the larger tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).

Keys that start with a query name run the whole query from the raw tables.
Keys under `fit_` and `solve_` time one step on staged inputs, as published
fit times do: `_25` are the brands (84 regressors), `_150` brand x type
(458 regressors).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.operators import covariance as cv  # noqa: E402
from panelweave.operators import fit as fm  # noqa: E402
from panelweave.operators import portfolio as pf  # noqa: E402
from panelweave.plans import all_queries  # noqa: E402
from panelweave.plans import models as md  # noqa: E402
from panelweave.session import local_session  # noqa: E402
from panelweave.sources import bindings as b  # noqa: E402
from panelweave.sources.scratch import stage  # noqa: E402

QUERIES = ("g16_model_comparison", "c01_realized_cov", "c03_rolling_cov", "c09_pagerank", "c11_rolling_network",
           "d03_shrunk_cov", "f00_moments", "f10_grid_search", "g07_diebold_mariano", "g08_confidence_set",
           "g16_performance")
MODELS = ("M1", "M2", "M3", "M3a", "M4", "M5")


def staged_inputs(spark, sf, asset, k):
    w, long, _ = md.full_design(spark, sf, asset)
    eq = stage(md.equations(w), "assets")
    layout = md.layout_of(k)
    links = md.asset_links(spark, sf, asset, eq)
    return w, long, eq, layout, links, md.rows_of(w, long, md.LAGS, layout.p)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registered = all_queries()
    took = {}

    def timed(name, make, check=None):
        began = time.perf_counter()
        made = make()
        if check is None:
            made.write.format("noop").mode("overwrite").save()
        else:  # the result is looked at, so that an empty one is not taken for a fast one
            check(made)
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    registered["c01_realized_cov"](spark, sf).collect()  # start the Python workers
    for name in QUERIES:
        timed(name, lambda: registered[name](spark, sf))
    for asset, k in (("p_brand", 25), ("p_brand,p_type", 150)):
        w, long, eq, layout, links, rows = staged_inputs(spark, sf, asset, k)
        mom = stage(fm.moments(rows, md.CUTS), "moments")
        for model in MODELS:
            configs = [c for c in md.FULL if c.model == model][:1]
            timed(f"fit_{model}_{k}", lambda: fm.fit(mom, configs, layout, links))
        timed(f"fit_grid_search_{k}", lambda: fm.grid_search(
            rows, long, w, eq, md.FULL, layout, md.CUTS, md.HORIZON, links, stage))
        returns = stage(b.trade_returns(spark, sf, asset), "returns")
        timed(f"solve_cov_{k}", lambda: cv.realized_cov(returns))
        cov = stage(cv.realized_cov(returns, ridge=1e-2), "cov")
        days = cov.select("day").distinct().count()

        def all_solved(weights, days=days, k=k):
            got = weights.groupBy("day").count().collect()
            assert len(got) == days and all(r["count"] == k for r in got), f"{len(got)} of {days} days solved"

        timed(f"solve_precision_{k}", lambda: pf.w_from_prec(cv.precision_cells(cv.glasso(cov, [2.0]))), all_solved)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
