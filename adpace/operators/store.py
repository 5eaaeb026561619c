"""The report store as a table bucketed and sorted by row hash, with Bloom filters on the hash.

An upsert compares each batch with what is stored under the batch's hashes only. The
store is bucketed by hash, so the stored side is read bucket by bucket without a shuffle,
and it is sorted by hash with a Parquet Bloom filter and min/max statistics of the hash per
row group. A batch of at most ``PROBE_HASHES`` distinct hashes hands them to the scan as a
filter: Spark's bucket pruning opens only the buckets that can hold them, and inside those
files row groups that cannot hold one are skipped. A larger batch reads every bucket, which
is what it has to compare with. Both ways give the same rows; they differ in what is read.
A load writes at most one file per bucket.

The rows of a large batch meet the store in slices by hash, one after the other, so that the disk
holds the shuffle of one slice; the store itself gets the new rows of all slices in one write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpace import schema as S
from adpace.scratch import bucketed_scans, discarded, shuffles_removed, work_dir
from adpace.sources.delivery import ROW_HASH

STORED_SCHEMA = T.StructType(
    S.DELIVERY_SCHEMA.fields + [T.StructField(ROW_HASH, T.StringType())]
)
#: Batches with at most so many distinct hashes give them to the stored side's scan.
PROBE_HASHES = 4096
#: Rows of a bucket to aim for: a task sorts those that a load adds to one bucket twice.
BUCKET_ROWS = 500_000
#: Slices of a batch of more than ``SLICE_ROWS`` rows.
SLICES = 8
SLICE_ROWS = 2_000_000
_BLOOM = {f"parquet.bloom.filter.enabled#{ROW_HASH}": "true"}


@dataclass(frozen=True)
class LoadResult:
    """How a load went: its mode and the rows it wrote (or parsed, to validate)."""

    mode: str
    rows: int


def new_rows(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a batch whose hash is not stored yet; duplicates collapse to one.

    Both sides meet partitioned by hash, which spreads evenly, and combine
    equal hashes before the shuffle. Of the stored table only the hash column
    is read. A restated row has another hash and is new.
    """
    seen = existing.select(ROW_HASH).distinct()
    return batch.dropDuplicates([ROW_HASH]).join(seen, ROW_HASH, "left_anti").select(
        *batch.columns
    )


def pruned_store(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rows that can share a hash with the batch: all, or those of its hashes if few.

    An estimate, which shuffles no hashes, tells batches with far too many.
    """
    if batch.agg(F.approx_count_distinct(ROW_HASH)).first()[0] > 2 * PROBE_HASHES:
        return stored
    few = [r[0] for r in batch.select(ROW_HASH).distinct().limit(PROBE_HASHES + 1).collect()]
    return stored.filter(F.col(ROW_HASH).isin(few)) if len(few) <= PROBE_HASHES else stored


def _bucketed(rows: DataFrame, buckets: int, mode: str) -> DataFrameWriter:
    return (
        rows.write.mode(mode).format("parquet").options(**_BLOOM, compression="zstd").bucketBy(buckets, ROW_HASH).sortBy(ROW_HASH)
    )


def create_store(
    spark: SparkSession, table: str, buckets: int, path: str | None = None
) -> None:
    """Create an empty store; ``path`` places its files outside the warehouse folder.

    Choose buckets so that one bucket fits a task: stored bytes / 256 MB or so.
    """
    writer = _bucketed(spark.createDataFrame([], STORED_SCHEMA), buckets, "errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def upsert_store(report: DataFrame, table: str, buckets: int) -> LoadResult:
    """Insert the rows of a report whose hash the store does not hold yet.

    ``buckets`` is the count that the store was created with; a missing store is created. Each task of the
    write holds one bucket, so a load adds at most one file per bucket. The batch is dealt by
    hash into the buckets once: duplicates collapse, the stored buckets are met and the new rows
    are written where they then lie.
    """
    if not report.sparkSession.catalog.tableExists(table):
        create_store(report.sparkSession, table, buckets)
    spark = report.sparkSession
    stored = spark.table(table)
    staged, merged = work_dir(spark, "upsert"), work_dir(spark, "merged")
    try:
        # Parsed and hashed once: the hashes that choose what is read are those of the rows added.
        batch, rows = _staged(report.select(*STORED_SCHEMA.fieldNames()), staged)
        known = pruned_store(batch, stored)
        if rows <= SLICE_ROWS:
            # Lies by hash in the buckets already; Spark leaves a second shuffle out then.
            fresh = _unseen(batch, known, buckets)
        else:
            fresh = _merged(batch, known, buckets, staged, merged)
        seen = Observation()
        counted = fresh.repartition(buckets, ROW_HASH).observe(
            seen, F.count(F.lit(1)).alias("rows")
        )
        with shuffles_removed(spark), bucketed_scans(spark):
            _bucketed(counted, buckets, "append").saveAsTable(table)
    finally:
        discarded(spark, staged)
        discarded(spark, merged)
    return LoadResult("upsert", seen.get["rows"])


def _staged(batch: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The batch as stored, in a folder for each slice, and its number of rows."""
    spark, seen = batch.sparkSession, Observation()
    sliced = batch.withColumn("_slice", F.pmod(F.xxhash64(ROW_HASH), F.lit(SLICES)).cast("int"))
    counted = sliced.observe(seen, F.count(F.lit(1)).alias("rows"))
    with shuffles_removed(spark):
        counted.write.partitionBy("_slice").option("compression", "zstd").parquet(path)
    return spark.read.schema(sliced.schema).parquet(path), seen.get["rows"]


def _unseen(batch: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """The batch's rows that are not stored yet, dealt into the buckets."""
    return new_rows(batch.drop("_slice").repartition(buckets, ROW_HASH), known)


def _merged(batch: DataFrame, known: DataFrame, buckets: int, staged: str, path: str) -> DataFrame:
    """The new rows of all slices, bucketed like the store; a staged slice goes once it is done."""
    spark, name = batch.sparkSession, f"merged_{uuid.uuid4().hex}"
    for k in range(SLICES):
        part = _unseen(batch.filter(F.col("_slice") == k), known, buckets)
        with shuffles_removed(spark):
            _bucketed(part, buckets, "append").option("path", path).saveAsTable(name)
        discarded(spark, f"{staged}/_slice={k}")
    rows = spark.table(name)
    # The scan knows its files and buckets by now; the files of a table with a path stay.
    spark.sql(f"DROP TABLE {name}")
    return rows
