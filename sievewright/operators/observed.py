"""Metrics of a table, collected while it is written: no second scan."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def builder_measures(skipped: Column, errors: Column, warnings: Column) -> dict[str, Column]:
    """Totals and rates of a build step by what is wrong with a row; null conditions are false."""
    no = lambda c: F.coalesce(c, F.lit(False))
    count = F.count(F.lit(1))
    counts = {"skipped": F.count_if(no(skipped)), "errors": F.count_if(no(errors)), "warnings": F.count_if(no(warnings))}
    rate = {f"{n[:-1] if n.endswith('s') else n}_rate": F.coalesce(F.try_divide(c, count), F.lit(0.0)) for n, c in counts.items()}
    return {"total": count, **counts, **rate}


def write_observed(df: DataFrame, path: str, measures: dict[str, Column], name: str = "written", mode: str = "errorifexists") -> dict[str, object]:
    """Writes df as Parquet and returns its measures, which the tasks that write collect; seconds and rows_per_second too.

    Measures are aggregates without DISTINCT. Should tasks run again, Spark counts each partition once, as the result of its job.
    """
    seen, began = Observation(name), time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *(m.alias(n) for n, m in measures.items())).write.mode(mode).parquet(path)
    out, seconds = dict(seen.get), time.monotonic() - began
    rows = out.pop("_rows")
    return out | {"seconds": seconds, "rows_per_second": rows / seconds if seconds > 0 else 0.0}


class Progress(StreamingQueryListener):
    """Sums of a stream's observed counts over its batches: stream.observe(name, ...) gives rows, this keeps them by name and measure.

    Add it by spark.streams.addListener(). A batch that runs again after a restart is counted by its id once.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, str, int], dict] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.batches[str(event.progress.id), name, event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))

    def totals(self, name: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for (_, n, _), row in self.batches.items():
            if n == name:
                for k, v in row.items():
                    out[k] = out.get(k, 0) + (v or 0)
        return out
