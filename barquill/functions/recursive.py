"""Averages that depend on their own last value, over rows of any number with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: (name, values from the columns so far, weight of a new value, finite values before the average counts)
Step = tuple[str, Callable[[pd.DataFrame], pd.Series], float, int]


def span(n: float) -> float:
    """The weight of an exponential average over n rows."""
    return 2.0 / (n + 1.0)


def averages(df: DataFrame, steps: list[Step], keys: tuple[str, ...] = ("symbol", "seg"), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Add exponential averages, one after the other: later steps may use the columns of earlier ones.

    The first finite value of a segment starts an average; null values are passed over, and where one stands the average is null. Rows are dealt by key and sorted
    once and then stream through Python in Arrow batches; what carries over from batch to batch is one number and one
    count for each step, so a symbol of any length needs no more memory than a batch.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name, *_ in steps)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            key = list(zip(*(pdf[k] for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            parts = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[lo:hi].copy()
                if key[lo] != current:
                    current, state = key[lo], {}
                for name, value, weight, minp in steps:
                    x = value(part).astype(float).replace([np.inf, -np.inf], np.nan)
                    held, count = state.get(name, (np.nan, 0))
                    smooth = pd.concat([pd.Series([held]), x]).ewm(alpha=weight, adjust=False, ignore_na=True).mean().to_numpy()[1:]
                    counts = count + x.notna().cumsum().to_numpy()
                    state[name] = (smooth[-1], int(counts[-1]))
                    part[name] = np.where((counts >= minp) & x.notna().to_numpy(), smooth, np.nan)
                parts.append(part)
            out = pd.concat(parts)
            for name, *_ in steps:
                out[name] = out[name].astype(object).where(out[name].notna(), None)
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
