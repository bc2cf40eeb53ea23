"""Loads driven by a control table that can be stopped anywhere and taken up again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from itertools import islice

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableproof.operators.filters import delta_window
from tableproof.operators.merge import advance_watermark

_EVENT = "table_name string, watermark_col string, lo timestamp_ntz, hi timestamp_ntz, state int, wm timestamp_ntz, loaded_rows bigint, error string"
#: States of a load in their order.
STATES = ("planned", "failed", "landed", "advanced")
_PLANNED, _FAILED, _LANDED, _ADVANCED = range(4)


class LoadJournal:
    """Journal and landed files of incremental loads in a folder that driver and executors share.

    A run plans one window per control row, lands each into a folder of its own, and advances the control table from
    what has landed. A load that failed keeps its planned window and is tried again by the next ``load`` of the run; it
    overwrites its folder, so no row is lost or landed twice. Tables are landed one job each and
    recorded ``group`` at a time, so no plan and no driver list grows with the number of control rows.
    """

    def __init__(self, spark: SparkSession, path: str, group: int = 50):
        self.spark, self.path, self.group = spark, path.rstrip("/"), group

    def _events(self) -> DataFrame:
        return self.spark.read.schema(f"{_EVENT}, run string").parquet(f"{self.path}/journal")

    def _record(self, events: DataFrame, run: str) -> None:
        events.select([F.col(c.split()[0]).cast(c.split()[1]) for c in _EVENT.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.path}/journal/run={run}")

    def state(self) -> DataFrame:
        """(run, table_name, state, lo, hi, wm, loaded_rows, error): the furthest state of every load; an event repeated changes nothing."""
        fields = ["state", "watermark_col", "lo", "hi", "wm", "loaded_rows", "error"]
        last = self._events().groupBy("run", "table_name").agg(F.max(F.struct(*fields)).alias("e")).select("run", "table_name", "e.*")
        return last.withColumn("state", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("state") + 1))

    def plan(self, control: DataFrame, hi: dt.datetime, run: str) -> None:
        """Plan ``(watermark, hi]`` of every control row that is behind ``hi``. A run that has a plan keeps it."""
        try:
            if self._events().where(F.col("run") == run).limit(1).count():
                return
        except PySparkException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        edge = F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz")
        rows = control.where(F.col("watermark_value") < edge).select(
            "table_name", "watermark_col", F.col("watermark_value").alias("lo"), edge.alias("hi"), F.lit(_PLANNED).alias("state"),
            F.lit(None).alias("wm"), F.lit(None).alias("loaded_rows"), F.lit(None).alias("error"),
        )
        self._record(rows, run)

    def folder(self, table: str, run: str) -> str:
        return f"{self.path}/landed/{table}/run={run}"

    def load(self, run: str, read: Callable[[str], DataFrame]) -> None:
        """Land what the run has planned and not landed; a table that cannot be read or written is recorded and left for the next call."""
        pending = self.state().where((F.col("run") == run) & F.col("state").isin("planned", "failed")).toLocalIterator()
        while some := list(islice(pending, self.group)):
            events = []
            for row in some:
                name, column, lo, hi = row["table_name"], row["watermark_col"], row["lo"], row["hi"]
                head = [F.lit(name).alias("table_name"), F.lit(column).alias("watermark_col"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")]
                try:
                    rows = delta_window(read(name), column, lo, hi)
                    rows.write.mode("overwrite").parquet(self.folder(name, run))
                    # Facts come from the files, not from the extract, which may have moved on.
                    landed = self.spark.read.schema(rows.schema).parquet(self.folder(name, run))
                    events.append(landed.agg(F.max(column).cast("timestamp_ntz").alias("wm"), F.count("*").alias("loaded_rows")).select(
                        *head, F.lit(_LANDED).alias("state"), "wm", "loaded_rows", F.lit(None).cast("string").alias("error")
                    ))
                except (PySparkException, Py4JError, OSError) as failure:
                    nothing = [F.lit(None).cast("timestamp_ntz").alias("wm"), F.lit(None).cast("bigint").alias("loaded_rows")]
                    events.append(self.spark.range(1).select(*head, F.lit(_FAILED).alias("state"), *nothing, F.lit(str(failure)[:1000]).alias("error")))
            self._record(reduce(DataFrame.unionAll, events), run)

    def advance(self, control: DataFrame, run: str, run_ts: dt.datetime, store: Callable[[DataFrame], None]) -> None:
        """Advance the control table from landed files, hand it to ``store``, then mark the loads.

        A stop between the two is harmless: watermarks never go back, so advancing again stores the same rows.
        """
        landed = self.state().where((F.col("run") == run) & (F.col("state") == "landed"))
        store(advance_watermark(control, landed.select("table_name", "wm"), run_ts))
        self._record(landed.withColumn("state", F.lit(_ADVANCED)), run)

    def landed(self, table: str) -> DataFrame:
        """All landed rows of a table; folders of loads that did not finish are not read."""
        done = self.state().where((F.col("table_name") == table) & F.col("state").isin("landed", "advanced")).select("run").collect()
        return self.spark.read.parquet(*[self.folder(table, r["run"]) for r in done])
