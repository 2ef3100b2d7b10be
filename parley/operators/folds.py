"""Ordered folds: rows are dealt by key, sorted, and pass through a state machine as they stream by.

A task holds the state of one key at a time, never the key's rows, so a key may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Machine:
    """State of one key: ``row`` takes the columns of a row, ``end`` closes the key; both give output rows.

    A machine that streams names the columns of its state; ``save`` gives them and ``load`` takes them back.
    """

    STATE = ""

    def save(self) -> tuple:
        return ()

    def load(self, *state) -> None:
        pass

    def row(self, *values) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def fold(rows: DataFrame, key: str | list[str], order: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """Rows (key, *output of the machine) for each key, of one column or several; ``schema`` names the columns after them.

    The machine is given all columns but the key, in the order of ``rows``.  Rows without a key are one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows, kind = rows.select(*keys, *[c for c in rows.columns if c not in keys]), dict(rows.dtypes)
    whole = "".join(f"`{k}` {kind[k]}, " for k in keys) + schema
    names = rows.sparkSession.createDataFrame([], whole).columns
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, None
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                own = tuple(None if pd.isna(k) else k for k in values[:n])
                if state is None or own != at:
                    if state is not None:
                        out.extend((*at, *x) for x in state.end())
                    state, at = machine(), own
                out.extend((*at, *x) for x in state.row(*values[n:]))
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(*at, *x) for x in state.end()], columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, whole)
