"""batch scoring of a trained one-layer recurrent network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import recurrent_forward


def score_sequences(seqs: DataFrame, parameters: dict, assets: list[str], temperature: float = 0.5,
                    model: str = "recurrent") -> DataFrame:
    """(model, t, day, asset, w_hat) for rows (t, day, seq array<array<double>>).

    The parameters (matrices of the four gates f, i, o, c and of the output)
    are sent to the executors once as a broadcast variable; their size depends
    on the network, not on the data. Rows are scored batch by batch.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(parameters)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gates, out = shared.value["gates"], shared.value["out"]
        for pdf in batches:
            if len(pdf):
                x = np.array([np.stack(s) for s in pdf["seq"]], dtype=float)
                y = recurrent_forward(x, gates, out, temperature)
                yield pd.DataFrame({"t": pdf["t"], "day": pdf["day"], "y": list(y)})

    scored = seqs.select("t", "day", "seq").mapInPandas(score, "t int, day date, y array<double>")
    names = F.array(*[F.lit(a) for a in assets])
    return scored.select(F.lit(model).alias("model"), "t", "day",
                         F.inline(F.arrays_zip(names, "y"))).toDF("model", "t", "day", "asset", "w_hat")
