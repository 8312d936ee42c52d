"""Windowed aggregates, the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import ROW, number_rows
from ..sources.shared import written


def _time(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("timestamp")


def tumbling(df: DataFrame, time: str, width: str, by: list[str], aggs: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates per window and ``by``; ``slide`` makes the windows overlap; ``late``: how long a stream waits (watermark)."""
    d = df.withColumn("__t", _time(df, time))
    if late:
        d = d.withWatermark("__t", late)
    w = F.window("__t", width, slide) if slide else F.window("__t", width)
    return d.groupBy(w.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in _names(aggs)])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates per session: events of ``by`` less than ``gap`` apart."""
    d = df.withColumn("__t", _time(df, time))
    if late:
        d = d.withWatermark("__t", late)
    return d.groupBy(F.session_window("__t", gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *_names(aggs))


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggs]


#: the column with a row's firing, where a sink gets many firings together
FIRING = "__firing"


class Counting:
    """A running count trigger; :meth:`awaitTermination` gives the sink what is left when the stream has ended."""

    def __init__(self, rows: int, sink, together: bool = False):
        self.rows, self.sink, self.together, self.number = rows, sink, together, 0
        self.rest: DataFrame | None = None  # what is held back, numbered from 0
        self.held = 0
        self.query: StreamingQuery | None = None

    def take(self, batch: DataFrame, _: int) -> None:
        numbered = number_rows(batch)  # a written table: numbers and rows are of one execution
        total = self.held + numbered.count()
        if total == self.held:
            return
        if self.rest is not None:
            numbered = self.rest.unionByName(numbered.withColumn(ROW, F.col(ROW) + self.held))
        if not self.together:
            numbered = written(numbered, "count-trigger")  # a firing's filter reaches the pages of its rows
        full = total // self.rows
        if full:
            self._give(numbered, full)
        self.held = total - full * self.rows
        self.rest = numbered.where(F.col(ROW) >= full * self.rows).withColumn(ROW, F.col(ROW) - full * self.rows) if self.held else None

    def _give(self, numbered: DataFrame, n: int) -> None:
        """The rows of the next ``n`` firings go to the sink."""
        first, self.number = self.number, self.number + n
        if self.together:
            firing = F.expr(f"{ROW} div {self.rows}") + first
            self.sink(numbered.where(F.col(ROW) < n * self.rows).withColumn(FIRING, firing).drop(ROW), first)
            return
        for k in range(n):
            self.sink(numbered.where((F.col(ROW) >= k * self.rows) & (F.col(ROW) < (k + 1) * self.rows)).orderBy(ROW).drop(ROW), first + k)

    def awaitTermination(self) -> None:  # noqa: N802  as a StreamingQuery's
        self.query.awaitTermination()
        if self.rest is not None:
            self._give(self.rest, 1)
            self.rest, self.held = None, 0


def every(stream: DataFrame, rows: int, sink, together: bool = False) -> Counting:
    """A count trigger: ``sink(frame, number)`` is called for every ``rows`` rows that came, in whatever micro-batches they did;
    fewer rows than that are held back until more come or the stream ends.

    ``together``: one call per micro-batch, with the rows of all its firings, each with the number of its firing (FIRING); the
    sink's second argument is the first of them. So the number of jobs doesn't grow with that of firings.
    """
    out = Counting(rows, sink, together)
    out.query = stream.writeStream.trigger(availableNow=True).foreachBatch(out.take).start()
    return out


def until_end(stream: DataFrame, sink) -> None:
    """Processes what there is and stops (the end-of-stream trigger)."""
    stream.writeStream.trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
