"""Embeddings of samples by a model that each worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: samples of different lengths to an array of one vector each.
Model = Callable[[list[np.ndarray]], np.ndarray]


def seeded_model(dim: int = 64, bands: int = 32, seed: int = 7) -> Model:
    """A stand-in without weights: log energies of frequency bands, turned by a seeded random matrix, of unit length."""
    turn = np.random.default_rng(seed).standard_normal((bands, dim))

    def run(samples: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(samples), dim))
        for i, x in enumerate(samples):
            power = np.abs(np.fft.rfft(x, n=max(2 * bands, len(x)))) ** 2
            energy = np.log1p([part.sum() for part in np.array_split(power, bands)])
            v = energy @ turn
            out[i] = v / (np.linalg.norm(v) + 1e-10)
        return out

    return run


def with_embeddings(df: DataFrame, samples: str = "samples", make_model: Callable[[], Model] = seeded_model, column: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with the model's vector of its column ``samples`` (array of numbers) as ``column``.

    ``make_model`` is called once for each task that has rows, on the worker; the model is given up to ``batch`` samples at a
    time and must treat each by itself, so that vectors do not depend on how rows are dealt.  Null or empty samples, and
    those with null values, have a null vector.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != column}
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kind.items()), f"`{column}` array<double>"])
    read = df.select(*[F.col(c) for c in kind], F.col(samples).cast("array<double>").alias("samples__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            given = rows.column(rows.num_columns - 1).to_pylist()
            heard = [i for i, x in enumerate(given) if x and None not in x]
            vectors: list = [None] * len(given)
            for at in range(0, len(heard), batch):
                model = make_model() if model is None else model
                part = heard[at : at + batch]
                for i, v in zip(part, model([np.asarray(given[i], dtype=float) for i in part]), strict=True):
                    vectors[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=[*kind, column])

    return read.mapInArrow(run, schema)
