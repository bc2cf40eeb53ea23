"""Exact deduplication against a persistent digest index, bucketed and sorted by the digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tableproof.llm.joins import lookup_join
from tableproof.session import fresh_path, materialize


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Table of all digests seen so far: digest, keep_id, batch, n_rows.

    ``location`` is a folder that driver and executors share. The table is bucketed and sorted by the
    digest, so a batch meets it in a sort-merge anti-join that shuffles the batch's digests only.
    A batch is appended after its anti-join. Running a named batch again, after a failure before or after
    its append, adds nothing that is already there and keeps the rows that it kept the first time.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        self._location = location
        if not spark.catalog.tableExists(name):
            schema = "digest binary, keep_id bigint, batch string, n_rows bigint"
            self._write(spark.createDataFrame([], schema))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").option("path", self._location).bucketBy(
            self.buckets, "digest"
        ).sortBy("digest").saveAsTable(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch; one row per row of the batch: doc_id, keep_id, group_size, kept, text_sha256.

        Within the batch the row with the largest id stays; a text that an earlier batch had is
        dropped in favour of that batch's row. ``group_size`` counts the rows with this text in
        the batch that brought it. Null texts count as empty, null ids lose against any id, and
        of rows that agree in id and text one stays. Only id and digest travel, never texts.
        ``batch`` names the batch, so that a retry knows the rows it brought itself; without a
        name every call is a batch of its own, and a second call meets the digests of the first.
        """
        batch = batch or uuid.uuid4().hex
        rows = materialize(
            docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
            .withColumn("row", F.monotonically_increasing_id()),
            "digests",
        )
        seen = materialize(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"),
                F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
                F.count("*").alias("n_rows"),
            ),
            "batch-digests",
        )
        fresh = seen.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        self._write(
            fresh.select("digest", "keep_id", F.lit(batch).alias("batch"), "n_rows")
            .repartition(self.buckets, "digest")
        )
        self.spark.catalog.refreshTable(self.name)
        known = self.table().select("digest", F.col("keep_id").alias("known_id"), "batch", F.col("n_rows").alias("group_size"))
        winners = materialize(seen.hint("merge").join(known, "digest"), "winners")
        total = rows.count()
        return lookup_join(rows, winners, ["digest"], "n_rows", total).select(
            "doc_id", F.col("known_id").alias("keep_id"), "group_size",
            # Row numbers differ between runs, so the row that stays is the one this run finds under the id that the index names.
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row")) & F.col("keep_id").eqNullSafe(F.col("known_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """Empty index under a name and folder of its own, with a bucket per shuffle partition."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, fresh_path(spark, "digest-index"), n)


def keep_first_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the index lets pass, all columns unchanged.

    Texts travel once, to meet their decision. The winner of a text is named by id; where several
    rows have that id and text, one of them stays. ``batch`` is as for ``DigestIndex.ingest``.
    """
    verdict = index.ingest(docs, batch=batch).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"))
    # The row travels as one struct, so that no column of its can clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), text_digest(F.col("text")).alias("digest"))
    rows = rows.join(verdict, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")
