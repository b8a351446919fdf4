"""The activity analysis; the pivot and two later tables are stored because they are read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from risewatch.operators import activity as A
from risewatch.session import durable


def activity_chain(
    records: DataFrame,
    windows: DataFrame,
    signals: DataFrame | None = None,
    fill: str = "forward_fill",
    method: str = "robust",
    smoothing: str = "median",
) -> DataFrame:
    """Clean, pivot, tag, drop dead rows, fill, standardise, smooth and extend with repository totals."""
    ok, _ = A.split_failed(records)
    tagged = durable(A.tag_anomalies(durable(A.activity_pivot(ok))))
    kept, _ = A.drop_anomalous(tagged)
    cols = A.count_columns(kept)
    filled = durable(A.fill_windows(kept, windows, fill, cols))
    out = A.smooth(A.standardize(filled, method, cols), 3, smoothing, cols)
    return A.extend_pivot(out, signals) if signals is not None else out
