"""Sample chunks from many sound files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _samples(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples) of a RIFF file of 32-bit floats or 16-bit integers."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            code, _, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            kind = {(3, 32): ("<f4", 1.0), (1, 16): ("<i2", 32768.0)}.get((code, bits))
        elif name == b"data":
            if kind is None:
                raise ValueError("neither 32-bit floats nor 16-bit integers")
            body = data[at + 8 : at + 8 + size]
            body = body[: len(body) // int(kind[0][-1]) * int(kind[0][-1])]
            return rate, (np.frombuffer(body, dtype=kind[0]) / kind[1]).astype(np.float32)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def read_wav_corpus(spark: SparkSession, glob: str, max_seconds: float | None = None, chunk: int = 1024) -> DataFrame:
    """A2: (path, chunk_ix, samples) of every file; the last chunk may be shorter.

    A file that is no sound file of a known kind gives one row with ``error`` and no samples.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rate, x = _samples(data)
                except (ValueError, struct.error) as e:
                    yield pd.DataFrame({"path": [path], "chunk_ix": [0], "samples": [None], "error": [str(e)]})
                    continue
                x = x if max_seconds is None else x[: int(max_seconds * rate)]
                parts = [x[i : i + chunk] for i in range(0, len(x), chunk)]
                yield pd.DataFrame({"path": path, "chunk_ix": range(len(parts)), "samples": parts, "error": None})

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(run, "path string, chunk_ix long, samples array<float>, error string")
