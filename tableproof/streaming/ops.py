"""Structured Streaming operators.

The functions take and return streaming DataFrames; the caller starts them.
``drain`` runs one to the end of what has arrived and returns the written table.
Event times are TIMESTAMP, because watermarks do not accept timestamps without zone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableproof.functions.hashing import hash_sum, row_hash
from tableproof.operators.changelog import ChangeLog
from tableproof.session import fresh_path


def stream_intake(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000, **options: str
) -> DataFrame:
    """New files of a folder as they arrive, a bounded number per batch."""
    return spark.readStream.format(fmt).schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).load(path)


def drain(stream: DataFrame, label: str, then: Callable[[], None] | None = None) -> DataFrame:
    """Append everything available to a new table in the shared folder, exactly once.

    ``then`` is called when all of it is in, and the query goes on from where it stopped: what it
    adds to the sources, such as a row that closes the open windows, comes after every row before.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def run() -> None:
        (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress")
            .outputMode("append").trigger(availableNow=True).start(path)
        ).awaitTermination()

    run()
    if then is not None:
        then()
        run()
    return spark.read.schema(stream.schema).parquet(path)


def closing_row(stream: DataFrame, ts_col: str, far: str = "2999-01-01") -> tuple[DataFrame, Callable[[], None]]:
    """The stream with one more source, and what puts the closing row there: far ahead in time, null otherwise.

    It moves the watermark past every window, so all of them close; its own window stays open and is
    never written.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "closing")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    closing = spark.readStream.schema(stream.schema).parquet(path)

    def close() -> None:
        row = spark.range(1).select(*[
            (F.lit(far) if f.name == ts_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema
        ])
        row.write.mode("append").parquet(path)

    return stream.unionByName(closing), close


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts_col: str, delay: str) -> DataFrame:
    """Drop replays of a key that arrive within ``delay``; state is dropped after it."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(stream: DataFrame, user_col: str, ts_col: str, gap: str, delay: str) -> DataFrame:
    """Closed sessions per user; a session closes once the watermark passes its end."""
    return (
        stream.withWatermark(ts_col, delay)
        .groupBy(F.session_window(ts_col, gap).alias("w"), user_col)
        .agg(F.count("*").alias("page_views"))
        .select(user_col, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "page_views")
    )


def stream_window_parity(
    source: DataFrame, build: DataFrame, columns: Sequence[str], ts_col: str, window: str, delay: str
) -> DataFrame:
    """Row count and checksum of both sides per closed tumbling window.

    Hash sums are mergeable, so the state is one small row per window, whatever the rate.
    """
    tagged = source.select(*columns, F.lit(1).alias("side")).unionByName(build.select(*columns, F.lit(-1).alias("side")))
    h = row_hash(columns)
    src, new = F.col("side") == 1, F.col("side") == -1
    sums = tagged.withWatermark(ts_col, delay).groupBy(F.window(ts_col, window).alias("w")).agg(
        F.count_if(src).alias("src_rows"),
        F.count_if(new).alias("build_rows"),
        hash_sum(F.when(src, h)).alias("src_hash"),
        hash_sum(F.when(new, h)).alias("build_hash"),
    )
    return sums.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_rows", "build_rows",
        ((F.col("src_rows") == F.col("build_rows")) & F.col("src_hash").eqNullSafe(F.col("build_hash"))).alias("passed"),
    )


def stream_upsert(
    stream: DataFrame, base: DataFrame, keys: Sequence[str], op_col: str, seq_col: str, label: str
) -> DataFrame:
    """Apply a change stream to ``base``, batch by batch, and return the table after the last batch.

    Batches go into a ``ChangeLog``: a batch never rewrites the table, reading does not slow down with their number, and a
    batch that the stream repeats after a failure is applied once. Of changes with one sequence number the
    one that ``delta_apply`` would keep decides. A feed without any change leaves the base as it is.
    """
    path = fresh_path(stream.sparkSession, label)
    log = ChangeLog(base, path, keys, op_col, seq_col)
    query = (
        stream.writeStream.foreachBatch(log.append).option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return log.table()


def event_time(ts: Column) -> Column:
    """Zone-less timestamp as the type that watermarks accept."""
    return ts.cast("timestamp")
