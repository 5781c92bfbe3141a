"""A Structured Streaming detector of discords: state is a bounded buffer of the newest points of each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def last_profile_value(v: np.ndarray, m: int) -> float:
    zone = max(1, m // 2)
    if len(v) < m + zone:
        return np.inf
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    return float(np.sqrt(((w[: len(w) - zone] - w[-1]) ** 2).sum(axis=1)).min())


def detect_discords(stream: DataFrame, window: int, m: int, threshold: float, id_col: str, value_col: str, *order: str) -> DataFrame:
    """(id, order columns, distance, flag) for each point of a stream, in order within each micro-batch.

    The buffer holds window + m points; until it is full nothing is flagged. A point that comes after later ones were
    processed counts at its arrival; bound the delay with a watermark.
    """
    size = window + m
    schema = stream.select(id_col, *order, value_col).schema
    fields = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in (id_col, *order))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        out = []
        for x in rows[value_col].astype(float):
            held = [*held, x][-size:]
            d = last_profile_value(np.array(held), m) if len(held) >= size else np.nan
            out.append((d, bool(threshold < d < np.inf)))
        state.update((held,))
        result = rows[[id_col, *order]].copy()
        result["distance"], result["flag"] = zip(*out, strict=True)
        yield result

    return stream.select(id_col, *order, value_col).groupBy(id_col).applyInPandasWithState(run, f"{fields}, distance double, flag boolean", "held array<double>", "append", "NoTimeout")
