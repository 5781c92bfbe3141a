"""Early classification of series that arrive point by point; state is the prefix of each undecided key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[np.ndarray], dict[str, float]]


def mean_model(train: DataFrame) -> Model:
    """Probabilities of a prefix by softmax of its distances to the class means, of (label, values); means are a small model."""
    from ..operators.clustering import euclidean_barycenter

    means = {str(r["label"]): np.array(r["values"]) for r in euclidean_barycenter(train, "label").collect()}

    def model(prefix: np.ndarray) -> dict[str, float]:
        d = {k: float(np.linalg.norm(m[: len(prefix)] - prefix[: len(m)])) for k, m in means.items()}
        most = max(d.values(), default=0.0)
        score = {k: np.exp(-x / most) if 0 < most < np.inf else 1.0 for k, x in d.items()}
        return {k: float(x / sum(score.values())) for k, x in score.items()}

    return model


def confidence(p: dict[str, float]) -> float:
    best = sorted(p.values(), reverse=True)
    return best[0] - best[1] if len(best) > 1 else best[0] if best else 0.0


def classify_early(stream: DataFrame, model: Model, shortest: int, step: int, threshold: float, id_col: str, value_col: str, *order: str) -> DataFrame:
    """(id, t, label, p, confidence) once for each key: at the first prefix of shortest, + step, ... points whose
    confidence reaches the threshold. Points count in order within a micro-batch; those after the decision are dropped,
    and with it the key's prefix. A key that never reaches the threshold has no row.
    """
    if shortest < 1 or step < 1:
        raise ValueError("lengths must be positive")
    schema = stream.select(id_col, *order, value_col).schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        out = []
        if not done:
            for x in pd.concat(list(frames)).sort_values(list(order), kind="stable")[value_col].astype(float):
                held.append(x)
                t = len(held)
                if t >= shortest and (t - shortest) % step == 0:
                    p = model(np.array(held))
                    if confidence(p) >= threshold:
                        label = min(p, key=lambda k: (-p[k], k))
                        out.append((key[0], t, label, p[label], confidence(p)))
                        held, done = [], True
                        break
        state.update((held, done))
        yield pd.DataFrame(out, columns=[id_col, "t", "label", "p", "confidence"])

    return stream.select(id_col, *order, value_col).groupBy(id_col).applyInPandasWithState(run, f"{id_col} {schema[id_col].dataType.simpleString()}, t int, label string, p double, confidence double", "held array<double>, done boolean", "append", "NoTimeout")
