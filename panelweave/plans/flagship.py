"""The minimum slice: weekly shares, three naive forecasts, one comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources import bindings as b
from .sqltext import predictions_cte, weights_cte


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = b.weights(spark, sf_dir)
    pred = b.naive_predictions(w)
    out = ev.compare(ev.accuracy(pred, w), ev.turnover_seq(pred))
    return out.select("model", F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"),
                      F.round("turnover_seq", 9).alias("turnover_seq"), "mse_rank")


QUERIES = {"g16_model_comparison": model_comparison}

ORACLES = {"g16_model_comparison": f"""
WITH {weights_cte()}, {predictions_cte()},
acc AS (SELECT model, avg((w_hat - w) * (w_hat - w)) AS mse, avg(abs(w_hat - w)) AS mae
        FROM predictions JOIN weights USING (day, asset) GROUP BY model),
moves AS (SELECT model, day, sum(abs(w_hat - before)) AS turnover FROM (
            SELECT *, lag(w_hat) OVER (PARTITION BY model, asset ORDER BY day) AS before FROM predictions)
          WHERE before IS NOT NULL GROUP BY 1, 2),
turn AS (SELECT model, avg(turnover) AS turnover_seq FROM moves GROUP BY model)
SELECT model, round(mse, 9) AS mse, round(mae, 9) AS mae, round(turnover_seq, 9) AS turnover_seq,
       CAST(rank() OVER (ORDER BY acc.mse) AS INT) AS mse_rank
FROM acc JOIN turn USING (model)"""}
