"""Counters of a run, read beside its result instead of from a second pass."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from reviewloom.functions.binding import with_computed
from reviewloom.functions.text import keep_english


def observed_cleaning(reviews: DataFrame, observation: Observation | str, text_col: str = "text") -> DataFrame:
    """The reviews with their English part, those left empty dropped; ``found``, ``kept`` and ``skipped`` are observed.

    With an ``Observation`` the counters are there once the first action has
    ended; with a name, a listener of a stream gets them batch by batch.
    """
    cleaned = with_computed(reviews, text_col, keep_english(F.col(text_col)))
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    counted = cleaned.observe(
        observation, F.count("*").alias("found"), F.count_if(~empty).alias("kept"), F.count_if(empty).alias("skipped")
    )
    return counted.filter(F.col(text_col) != "")


class MetricsListener(StreamingQueryListener):
    """Sums the observed metrics of streams by name; register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            for key, value in row.asDict().items():
                self.totals[name][key] += value or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
