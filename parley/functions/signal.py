"""Frame weights, silence and settings as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_weights(act: Column) -> Column:
    """Weight of each speaker in a frame, low where several speak; 1e-8 at least."""
    whole = F.aggregate(act, F.lit(0.0), lambda s, x: s + F.exp(10 * x))
    return F.transform(act, lambda x: F.greatest(F.lit(1e-8), F.pow(x, F.lit(3)) * F.pow(F.exp(10 * x) / whole, F.lit(3))))


def sample_weights(weights: Column, n: Column, step: int = 270) -> Column:
    """Each frame's weight for ``step`` samples, cut or filled with zeros to ``n`` samples."""
    flat = F.flatten(F.transform(weights, lambda x: F.array_repeat(x, step)))
    fill = F.array_repeat(F.lit(0.0), F.greatest(n - F.size(flat), F.lit(0)).cast("int"))
    return F.slice(F.concat(flat, fill), F.lit(1), n.cast("int"))


def trim_silence(samples: Column, threshold: float = 0.005, window: int = 1600) -> Column:
    """Samples from the first loud window to the last; unchanged below four windows or if none is loud.

    The search from the end stops before the second window.
    """
    n = F.size(samples)

    def loud(i: Column) -> Column:
        part = F.slice(samples, i + 1, F.lit(window))
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x) / window) > threshold

    first = F.get(F.filter(F.sequence(F.lit(0), n - window - 1, F.lit(window)), loud), F.lit(0))
    last = F.get(F.filter(F.sequence(n - window, F.lit(window + 1), F.lit(-window)), loud), F.lit(0))
    start, end = F.coalesce(first, F.lit(0)), F.coalesce(last + window, n)
    return F.when((n >= 4 * window) & (end > start), F.slice(samples, start + 1, end - start)).otherwise(samples)


def percent(score: Column) -> Column:
    """Whole per cent, towards zero."""
    return (score * 100).cast("long")


def plain_line(ts: Column, speaker: Column, content: Column) -> Column:
    """A transcript line; without a speaker, time and text only."""
    named = F.when(F.coalesce(speaker, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), speaker, F.lit("] ")))
    return F.concat(F.lit("["), ts, F.lit("] "), named, content)


def markdown_line(ts: Column, speaker: Column, content: Column) -> Column:
    """The same in Markdown."""
    named = F.when(F.coalesce(speaker, F.lit("")) == "", "").otherwise(F.concat(F.lit(" **"), speaker, F.lit(":**")))
    return F.concat(F.lit("**["), ts, F.lit("]**"), named, F.lit(" "), content)


def update_settings(doc: Column, patch: Column) -> Column:
    """A settings map with a patch laid over it; keys that the patch lacks stay, a null document is empty."""
    doc = F.coalesce(doc, F.from_json(F.lit("{}"), "map<string,string>"))
    return F.map_zip_with(doc, patch, lambda k, old, new: F.coalesce(new, old))


def checked_patch(patch: Column, kinds: dict[str, str]) -> Column:
    """A JSON patch as a map; an error where a known key's value has not its kind (int, double, string or boolean)."""
    whole = F.try_parse_json(patch)
    wrong = [
        F.when(F.try_variant_get(whole, f"$.{key}", "variant").isNotNull() & ~F.coalesce(_fits(whole, key, kind), F.lit(False)), F.lit(f"invalid type for {key}: expected {kind}"))
        for key, kind in kinds.items()
    ]
    found = F.from_json(patch, "map<string,string>")
    return F.when(F.coalesce(*wrong, F.lit(None)).isNotNull(), F.raise_error(F.coalesce(*wrong)).cast("map<string,string>")).otherwise(found) if wrong else found


def _fits(whole: Column, key: str, kind: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(whole, f"$.{key}", "variant"))
    return {"int": found == "BIGINT", "string": found == "STRING", "boolean": found == "BOOLEAN", "double": found.rlike("^(DECIMAL|DOUBLE|BIGINT)")}[kind]


def settings(doc: Column, defaults: dict[str, tuple[str, object]]) -> Column:
    """A JSON document as a map: known keys of the right kind, else their default, and all other keys as they are.

    ``defaults`` gives kind and default of the known keys; a document that is no object is all defaults.
    """
    known = F.create_map(*[x for key, (kind, default) in defaults.items() for x in (F.lit(key), setting(doc, key, kind, default).cast("string"))])
    whole = F.coalesce(F.from_json(doc, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    return F.map_concat(known, F.map_filter(whole, lambda k, v: ~k.isin(*defaults)))


def _pitches(x: np.ndarray) -> np.ndarray:
    """Of signals of one length, a row each."""
    if not x.shape[1]:
        return np.full(len(x), 0.5)
    size = np.abs(np.fft.rfft(x, axis=1))
    pitch = (size @ np.arange(size.shape[1])) / (size.sum(axis=1) + 1e-10) / (0.4 * size.shape[1])
    return np.where(np.sqrt((x * x).mean(axis=1)) <= 0.003, 0.5, np.clip(pitch, 0.0, 1.0))


def spectral_centroid(samples: Column) -> Column:
    """Mean frequency bin by magnitude, as a share of 0.4 of the bins, 0 to 1; 0.5 if the level is 0.003 or less."""

    def apply(rows: pd.Series) -> pd.Series:
        out, size = np.full(len(rows), np.nan), rows.map(lambda x: -1 if x is None else len(x)).to_numpy()
        for n in np.unique(size[size >= 0]):
            out[size == n] = _pitches(np.stack(rows[size == n].to_list()).astype(float).reshape(-1, n))
        return pd.Series(out).astype(object).where(size >= 0, None)

    return F.pandas_udf(apply, "double")(samples)


def setting(doc: Column, key: str, kind: str, default) -> Column:
    """A key of a JSON settings document if its value has the kind (int, double, string or boolean), else ``default``."""
    whole = F.try_parse_json(doc)
    return F.coalesce(F.when(_fits(whole, key, kind), F.try_variant_get(whole, f"$.{key}", kind)), F.lit(default))
