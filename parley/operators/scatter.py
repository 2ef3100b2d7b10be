"""Scatter of embeddings inside their speakers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.matching import sum_vectors


def within_scatter(df: DataFrame, key: str, vector: str, ridge: float = 1e-4) -> DataFrame:
    """(i, j, x) of the mean outer product around each speaker's mean, plus ``ridge`` on the diagonal.

    Speakers with one row are left out.  A task adds up one d x d matrix, so what is shuffled does not grow
    with the rows.
    """
    means = sum_vectors(df, [key], vector).where("n >= 2").select(key, F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    centred = df.join(means, key).select(F.zip_with(F.col(vector).cast("array<double>"), "mean", lambda x, y: x - y).alias("v"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for f in frames:
            if len(f):
                m = np.stack(f["v"].to_numpy())
                total, n = m.T @ m if total is None else total + m.T @ m, n + len(f)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel(), "n": n})

    sums = centred.mapInPandas(partial, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("i", "j", (F.col("s") / F.col("n") + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("x"))


def whiten(df: DataFrame, key: str, vector: str, least_rows: int = 8) -> DataFrame:
    """``df`` with its vectors centred and scaled so that the scatter inside speakers is even in all directions.

    Unchanged below two speakers of two rows and ``least_rows`` rows of such speakers.  Only the d x d scatter and the
    mean, whose size does not grow with the rows, pass through the driver.
    """
    rich = df.groupBy(key).agg(F.count(F.when(F.col(vector).isNotNull(), 1)).alias("n")).where("n >= 2").agg(F.count("*").alias("speakers"), F.sum("n").alias("rows")).first()
    if rich.speakers < 2 or rich.rows < least_rows:
        return df
    cells = within_scatter(df, key, vector).toPandas()
    d = int(cells["i"].max()) + 1
    scatter = np.zeros((d, d))
    scatter[cells["i"], cells["j"]] = cells["x"]
    mean = sum_vectors(df.withColumn("__all", F.lit(1)), ["__all"], vector).first()
    values, axes = np.linalg.eigh(scatter)
    centre, turn = np.array(mean.total) / mean.n, axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        held = v.notna().to_numpy()
        turned = iter((np.stack(v[held].to_list()) - centre) @ turn.T if held.any() else ())
        return pd.Series([next(turned) if h else None for h in held], index=v.index, dtype=object)

    return df.withColumn(vector, apply(F.col(vector).cast("array<double>")))
