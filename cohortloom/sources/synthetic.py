"""Synthetic cohorts for tests and examples, from a seed alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def cohort(spark: SparkSession, n: int = 60, responders: int | None = None, seed: int = 20260910, regions: int = 6) -> DataFrame:
    """study_id, row_pos, clinical columns, pet_0.. and t1_0.., y: values without any relation to y."""
    turn = np.random.default_rng(seed)
    m = n // 2 if responders is None else responders
    if not 0 <= m <= n:
        raise ValueError("more responders than people")
    data = {
        "study_id": [f"SYN{k:05d}" for k in range(n)],
        "row_pos": np.arange(n),
        "age": turn.uniform(8, 60, n),
        "male": turn.integers(0, 2, n).astype(float),
        "duration": turn.uniform(1, 40, n),
        "log_frequency": turn.uniform(0, 5, n),
        "lesional": turn.integers(0, 2, n).astype(float),
        "scanner": turn.integers(0, 2, n).astype(float),
        **{f"pet_{k}": turn.normal(1.1, 0.1, n) for k in range(regions)},
        **{f"t1_{k}": turn.normal(2.5, 0.15, n) for k in range(regions)},
        "y": turn.permutation(np.r_[np.ones(m, int), np.zeros(n - m, int)]),
    }
    return spark.createDataFrame(pd.DataFrame(data))
