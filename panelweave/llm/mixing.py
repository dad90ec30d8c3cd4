"""Mixing sources to target weights by entropy balancing.

Document i of a source gets the rate w_i closest to 1 in relative entropy among
those that give the source its target of tokens, with 0 <= w_i <= cap:

    w_i = min(cap, exp(lambda * size_i / mean size))

The multiplier of each source solves its convex dual.  A Newton step needs two sums
over the source, of the tilted sizes and of their derivative.  Since a rate depends
on source and size only, the sums run over the table of (source, size, count), in
decimals, so that they are exact and reruns agree bit for bit.  Only one number per
source, not per document, visits the driver.

Rates become copies (floor or ceiling) by error feedback from long documents to
short ones, in small buckets of a source, so a source of any size spreads over many
tasks and still comes out within a few words per bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.scratch import drop_staged, stage

CAP = 3
BUCKET_ROWS = 2000
SATURATED = 1e6


def targets(sizes: dict, weights: dict, cap: float = CAP) -> dict:
    """Share the sum of sizes by weight; no source above cap times its size, the excess reshared by weight."""
    total = float(sum(sizes.values()))
    open_, out = set(sizes), {}
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > cap * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / weight for s in open_}
            break
        out |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def cyclic_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: k % 3 + 1 for k, s in enumerate(order)}


def _table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A small table of the driver's; from Arrow, since a list of rows starts Python workers of another kind on the executors."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def _rate(lam: Column, scaled: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * scaled, F.lit(700.0))))


def solve(sizes: DataFrame, wanted: dict, totals: dict, cap: float, tolerance: float = 1e-9, most: int = 100) -> dict:
    """The multiplier of each source; sizes: source, size, n.  Newton steps kept inside a bracket."""
    spark = sizes.sparkSession
    lam, low, high, live = {}, {}, {}, set()
    for s, (tokens, _) in totals.items():
        if tokens <= 0 or abs(wanted[s] - tokens) <= tolerance * tokens:
            lam[s] = 0.0
        elif wanted[s] >= cap * tokens * (1 - 1e-12):
            lam[s] = SATURATED
        else:
            lam[s], low[s], high[s] = 0.0, -math.inf, math.inf
            live.add(s)
    for _ in range(most):
        if not live:
            break
        now = _table(spark, [(s, lam[s], totals[s][0] / totals[s][1]) for s in sorted(live, key=lambda s: (s is None, s or ""))],
                     {"src": pa.string(), "lam": pa.float64(), "mean": pa.float64()})
        joined = sizes.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("src")))
        rate = _rate(F.col("lam"), F.col("size") / F.col("mean"), cap)
        tilted = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, tilted * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy("src").agg(F.sum(tilted.cast("decimal(38,6)")).alias("g"),
                                         F.sum(slope.cast("decimal(38,6)")).alias("d")).collect()
        for r in sums:
            s, g, d = r["src"], float(r["g"]), float(r["d"])
            if abs(g - wanted[s]) <= max(tolerance * wanted[s], 1e-5):
                live.discard(s)
                continue
            if g < wanted[s]:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            # Newton on the logarithm of the sum, which is nearly linear
            step = lam[s] + math.log(wanted[s] / g) * g / d if d > 0 and g > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = (lam[s] - 1) * 2 if math.isinf(low[s]) else (lam[s] + 1) * 2
                else:
                    step = (low[s] + high[s]) / 2
            if step == lam[s] or high[s] - low[s] <= 1e-13 * max(1.0, abs(step)):
                live.discard(s)
            lam[s] = step
    return {s: float(f"{v:.12g}") for s, v in lam.items()}


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one bucket: floor or ceiling of the rate, the error carried from long to short documents."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    size, rate = pdf["size"].to_numpy("f8"), pdf["rate"].to_numpy("f8")
    whole = np.floor(rate)
    part = rate - whole
    copies, owed = whole.astype("i8"), 0.0
    for k in np.flatnonzero(part > 0).tolist():
        owed += part[k] * size[k]
        if owed >= size[k] / 2:
            copies[k] += 1
            owed -= size[k]
    return pdf.assign(copies=copies).drop(columns=["source", "bucket"])


def mix(sized: DataFrame, weights=cyclic_weights, cap: int = CAP, most_sources: int = 100_000) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies of every row.

    sized: doc_id, source, size (tokens; not null).  Null sources are one source.
    `weights` maps the list of sources to their weights.  A row without tokens has
    rate and copies 1 and adds nothing.  Repeated rows are rounded like other rows.
    Tables of one row per source are broadcast.  More than most_sources sources raise ValueError, since their weights, one number
    per source, are held by the driver.
    """
    sized = stage(sized.select("doc_id", "source", F.col("size").cast("long").alias("size")), "mix-sizes")
    counts = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    found = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("n"))
    found = found.limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = {r["source"]: (r["tokens"], r["n"]) for r in found}
    wanted = targets({s: t for s, (t, _) in totals.items()}, weights(list(totals)), cap)
    lam = solve(counts, wanted, totals, cap)
    drop_staged(counts)
    table = _table(
        sized.sparkSession, [(s, lam[s], t / n if t else 1.0, t, wanted[s], -(-n // BUCKET_ROWS)) for s, (t, n) in totals.items()],
        {"src": pa.string(), "lam": pa.float64(), "mean": pa.float64(), "source_size": pa.int64(), "target": pa.float64(),
         "buckets": pa.int64()})
    rated = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "source", "size", "source_size", "target",
        _rate(F.col("lam"), F.col("size") / F.col("mean"), cap).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "size"), "buckets").alias("bucket"), F.col("source").alias("origin"))
    schema = "doc_id long, size long, source_size long, target double, rate double, origin string, copies long"
    done = rated.groupBy("source", "bucket").applyInPandas(_round, schema)
    return done.withColumnRenamed("origin", "source")
