"""Append-only logs as streams: tolerant parsing, windowed means with late data, and early stopping with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines that appear in a folder; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("mode", "DROPMALFORMED").json(path)


def windowed_means(stream: DataFrame, time: str, key: str, value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, key, n, mean) per tumbling window; rows later than ``late`` are left out, state is dropped after it."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def early_stops(stream: DataFrame, run: str, step: str, loss: str, patience: int, delta: float) -> DataFrame:
    """(run, stop): emitted once per run when ``patience`` steps in a row did not beat the best loss by ``delta``.

    State per run: best loss, steps since, and whether it stopped. Steps of one micro-batch are taken in order; a step
    that arrives in a later batch than its successors counts when it arrives.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, since, stopped = state.get if state.exists else (float("inf"), 0, False)
        for pdf in [pd.concat(list(frames)).sort_values(step)]:
            for s, x in zip(pdf[step], pdf[loss], strict=True):
                if stopped:
                    break
                if x <= best - delta:
                    best, since = float(x), 0
                else:
                    best, since = min(best, float(x)), since + 1
                    if since >= patience:
                        stopped = True
                        yield pd.DataFrame({"run": [key[0]], "stop": [int(s)]})
        state.update((best, since, stopped))

    rows = stream.select(F.col(run).cast("string").alias(run), F.col(step).cast("bigint").alias(step), F.col(loss).cast("double").alias(loss))
    return rows.groupBy(run).applyInPandasWithState(update, "run string, stop bigint", "best double, since int, stopped boolean", "append", "NoTimeout")
