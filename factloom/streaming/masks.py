"""Stream forms of the ordered operators: a masked range and windowed counts of findings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_kinds(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of a stream (ts, kind): counts in event time, closed by the watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "kind", "n")


def active_between(events: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows of a stream (part, ord, kind) from a start mark up to, not including, the next stop mark of their part.

    One flag a part is kept between batches; rows are taken in order of ``ord`` within a batch.
    """
    import pandas as pd

    def run(key, frames: Iterator[pd.DataFrame], state):
        active = state.get[0] if state.exists else False
        pdf = pd.concat(list(frames)).sort_values("ord")
        keep = []
        for kind in pdf["kind"]:
            active = True if kind == start else False if kind == stop else active
            keep.append(active)
        state.update((bool(active),))
        yield pdf.loc[keep, ["part", "ord", "kind"]]

    return events.select("part", "ord", "kind").groupBy("part").applyInPandasWithState(run, "part long, ord long, kind string", "active boolean", "append", "NoTimeout")
