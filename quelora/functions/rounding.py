"""Half-even rounding of exact binary values, for the few rows that an aggregate gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def exact_round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Rounds columns as Python's round() does; the built-in one rounds half up on the decimal string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, n in digits.items():
                batch[name] = [None if x is None or x != x else round(x, n) for x in batch[name]]
            yield batch

    return df.mapInPandas(run, df.schema)
