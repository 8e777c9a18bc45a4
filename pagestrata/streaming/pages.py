"""Pages and histories as streams: arriving pages are analyzed batch by batch, histories are kept by page."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..html.udf import page_data
from ..operators.history import KEPT
from ..operators.scoring import analyze
from ..sources.pages import PAGES

TREND = "url_norm STRING, ts TIMESTAMP, total_score DOUBLE, previous_score DOUBLE, delta DOUBLE, direction STRING, analysis_count INT"


def page_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def analyze_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, as_of: str | None = None):
    """Starts a query that gives each batch's results to ``sink``; a batch that is run again has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(analyze(page_data(batch, None if as_of is None else int(as_of[:4]) + 1), None if as_of is None else F.lit(as_of).cast("timestamp")), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _trend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entries of one page against the entry before them in time; the state keeps the newest entries, in order of time.

    An entry that comes late is compared with what was before it then; what has been told of later ones stays as it is.
    """
    times, scores = map(list, state.get) if state.exists else ([], [])
    out = []
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    for ts, score in zip(rows["ts"], rows["total_score"]):
        at = bisect_right(times, int(ts.value))
        before = scores[at - 1] if at else None
        delta = None if before is None else math.floor((score - before) * 10 + 0.5) / 10
        sign = None if delta is None else "up" if delta > 0 else "down" if delta < 0 else "flat"
        times.insert(at, int(ts.value))
        scores.insert(at, float(score))
        times, scores = times[-KEPT:], scores[-KEPT:]
        out.append((key[0], ts, score, before, None if delta is None else abs(delta), sign, len(scores)))
    state.update((times, scores))
    yield pd.DataFrame(out, columns=["url_norm", "ts", "total_score", "previous_score", "delta", "direction", "analysis_count"])


def history_stream(entries: DataFrame) -> DataFrame:
    """Trend of each entry (url_norm, ts, total_score) against the one before it, computed before it is stored."""
    return entries.groupBy("url_norm").applyInPandasWithState(_trend, TREND, "times ARRAY<BIGINT>, scores ARRAY<DOUBLE>", "append", GroupStateTimeout.NoTimeout)


def daily_stream(reports: DataFrame, late: str = "1 day") -> DataFrame:
    """The first report of a page and day, when the watermark has passed the day; its state goes then."""
    days = reports.withWatermark("ts", late).groupBy("url_norm", F.window("ts", "1 day"))
    return days.agg(F.min_by(F.struct(*reports.columns), "ts").alias("first")).select("first.*")
