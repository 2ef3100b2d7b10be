"""Profile tables of which the vectors are encrypted at rest, with a mark on each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protect(table: DataFrame, column: str, key: Column) -> DataFrame:
    """Encrypt a vector column (authenticated); rows that are marked already stay, null and empty vectors stay too.

    Adds ``<column>_sealed`` (binary) and empties the vector.  ``key``: 16, 24 or 32 bytes.
    """
    sealed = f"{column}_sealed"
    kind = dict(table.dtypes)[column]
    if sealed not in table.columns:
        table = table.withColumn(sealed, F.lit(None).cast("binary"))
    fresh = F.col(sealed).isNull() & (F.size(column) > 0)
    made = F.aes_encrypt(F.to_json(F.col(column).cast("array<double>")).cast("binary"), key, F.lit("GCM"))
    table = table.withColumn(sealed, F.when(fresh, made).otherwise(F.col(sealed)))
    return table.withColumn(column, F.when(F.col(sealed).isNotNull(), F.lit(None).cast(kind)).otherwise(F.col(column)))


def unprotect(table: DataFrame, column: str, key: Column) -> DataFrame:
    """The table with its vectors (as doubles); a row that was changed since, or another key, is an error."""
    sealed = f"{column}_sealed"
    text = F.aes_decrypt(F.col(sealed), key, F.lit("GCM")).cast("string")
    return table.withColumn(column, F.coalesce(F.from_json(text, "array<double>"), F.col(column).cast("array<double>"))).drop(sealed)
