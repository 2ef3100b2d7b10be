"""The ordered and vector operators as table functions for SQL.

``register(spark)`` makes them known by name.  Each takes a table argument that is dealt by its key::

    SELECT * FROM speech_segments(TABLE(frames) PARTITION BY stream_id ORDER BY seq)

The key is the table's first column, for ordered functions the second one is the order; others follow as listed
in ``FUNCTIONS``.  Rows stream through the state of one key, as in the DataFrame forms, so no function gathers the
rows of a key; what Spark calls a grouped aggregate function would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from parley.operators.exemplars import unit
from parley.operators.folds import Machine
from parley.operators.identify import Limits, Viterbi, _One
from parley.operators.ordered import Endpoint, Recent, Segments, Speech


class _Sum(Machine):
    """The direction of the mean vector, and the number of rows."""

    def __init__(self):
        self.total, self.n = None, 0

    def vector(self, x: np.ndarray) -> np.ndarray:
        return x

    def row(self, x) -> Iterator[tuple]:
        if x is not None:
            x = self.vector(np.asarray(x, dtype=float))
            self.total, self.n = x.copy() if self.total is None else self.total + x, self.n + 1
        return iter(())

    def end(self) -> list[tuple]:
        return [(None if self.total is None else unit(self.total / self.n).tolist(), self.n)]


class _Quality(_Sum):
    """D3: mean pairwise cosine, 0 to 1, from the sum of unit vectors."""

    def vector(self, x: np.ndarray) -> np.ndarray:
        return unit(x)

    def end(self) -> list[tuple]:
        if self.n < 2:
            return [(0.0, self.n)]
        mean = (self.total @ self.total - self.n) / (self.n * (self.n - 1))
        return [(float(np.clip(mean, 0.0, 1.0)), self.n)]


class _Scatter(Machine):
    """D5 of one key: (i, j, x) of the summed outer products around the mean, by a running mean, and the rows."""

    def __init__(self):
        self.mean, self.cells, self.n = None, None, 0

    def row(self, x) -> Iterator[tuple]:
        if x is not None:
            x = np.asarray(x, dtype=float)
            if self.mean is None:
                self.mean, self.cells = np.zeros(len(x)), np.zeros((len(x), len(x)))
            self.n += 1
            gap = x - self.mean
            self.mean = self.mean + gap / self.n
            self.cells += np.outer(gap, x - self.mean)
        return iter(())

    def end(self) -> Iterator[tuple]:
        d = 0 if self.mean is None else len(self.mean)
        return ((i, j, float(self.cells[i, j]), self.n) for i in range(d) for j in range(d))


class _Smooth(Machine):
    """The labels of a key are known at its end only; until then it holds them."""

    def __init__(self, stay: float = 0.99, hit: float = 0.9):
        self.rows, self.how = [], (stay, hit)

    def row(self, at, label) -> Iterator[tuple]:
        if label is not None:
            self.rows.append((at, label))
        return iter(())

    def end(self) -> Iterator[tuple]:
        machine = Viterbi(*self.how)
        machine.row(0, None, None, {label for _, label in self.rows})
        for at, label in self.rows:
            yield from machine.row(1, at, label, None)
        yield from machine.end()


class _Loud(Speech):
    """E7 over probabilities; without one a frame is quiet."""

    def __init__(self, limit: float = 0.5, speech: int = 15, silence: int = 9, most: int = 187):
        super().__init__(speech, silence, most)
        self.limit = limit

    def row(self, at, prob) -> Iterator[tuple]:
        return super().row(at, prob is not None and prob >= self.limit)


class _Chunks(Endpoint):
    def row(self, at, speech) -> Iterator[tuple]:
        return super().row(at, bool(speech))


#: Name: (machine of the arguments after the table, number of columns after the key, result columns after the key).
#: "at" stands for the type of the table's second column, "label" for that of its third.
FUNCTIONS: dict[str, tuple[Callable[..., Machine], int, str]] = {
    "speech_segments": (_Loud, 2, "first int, stop int"),  # key, order, prob; limit, speech, silence, most
    "endpoint": (_Chunks, 2, "first long, last long, n_chunks int"),  # key, order, is_speech; chunk_sec
    "dedupe_recent": (lambda n=5: Recent(n), 2, "at at"),  # key, order, normal form; n
    "scd_segments": (lambda least=24000: Segments(least), 3, "start long, stop long"),  # key, start sample, far, total samples; least
    "identify": (lambda: _One(Limits()), 4, "seg_ix at, speaker_id int, outcome string"),  # key, seg_ix, embedding, duration_sec, rms
    "viterbi_smooth": (_Smooth, 2, "at at, label label"),  # key, order, label; stay, hit
    "centroid": (_Sum, 1, "centroid array<double>, n long"),  # key, vector
    "quality_score": (_Quality, 1, "quality double, n long"),  # key, vector
    "scatter": (_Scatter, 1, "i int, j int, x double, n long"),  # key, vector
}


_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "array<double>": ArrayType(DoubleType())}


def _function(name: str):
    make, width, result = FUNCTIONS[name]

    class Function:
        @staticmethod
        def analyze(rows: AnalyzeArgument, *others: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or len(rows.dataType.fields) <= width:
                raise ValueError(f"{name} takes a table with a key and {width} columns")
            fields = rows.dataType.fields
            out = [StructField(fields[0].name, fields[0].dataType)]
            for column in result.split(", "):
                column, kind = column.split(" ")
                known = {"at": fields[1].dataType, "label": fields[min(2, width)].dataType}
                out.append(StructField(column, known.get(kind) or _TYPES[kind]))
            return AnalyzeResult(StructType(out))

        def __init__(self):
            self.machine, self.key = None, None

        def eval(self, row, *others):
            values = list(row)
            if self.machine is None:
                self.machine, self.key = make(*others), values[0]
            for found in self.machine.row(*values[1 : 1 + width]):
                yield (self.key, *found)

        def terminate(self):
            if self.machine is not None:
                for found in self.machine.end():
                    yield (self.key, *found)

    return udtf(Function)


def register(spark: SparkSession) -> None:
    """Make all FUNCTIONS known to the session's SQL under their names."""
    for name in FUNCTIONS:
        spark.udtf.register(name, _function(name))
