"""The abort rule over a stream of verdicts: counters for each run, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def failure_counts(verdicts: DataFrame, tolerance: int, consecutive: int = 5) -> DataFrame:
    """(run, errors, in_a_row, aborted) after each batch of a stream (run, at, state); `at` orders a batch's verdicts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        errors, row, aborted = state.get if state.exists else (0, 0, False)
        for said in pd.concat(list(batches)).sort_values("at")["state"]:
            errors, row = (errors + 1, row + 1) if said == "error" else (errors, 0)
            aborted = aborted or row >= consecutive or errors >= tolerance
        state.update((errors, row, aborted))
        yield pd.DataFrame({"run": [key[0]], "errors": [errors], "in_a_row": [row], "aborted": [aborted]})

    out = "run string, errors long, in_a_row long, aborted boolean"
    return verdicts.groupBy("run").applyInPandasWithState(step, out, "errors long, in_a_row long, aborted boolean", "update", "NoTimeout")
