"""Report rows stored by order, so that what belongs to one order is computed where it lies.

A line item usually lies within one order. The rows of such orders need no shuffle for
rollups by line item or size: grouping by order as well changes no group, and the stored
rows lie by order already. Nothing is assumed, though: orders that share a line item with
another one, or hold rows without an order or a line item, are found and kept apart, and
their rows take the general way. No line item has rows on both sides.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpace.scratch import dealt_into, shuffles_removed, work_dir, written

#: Rows of a bucket to aim for: a task sorts those of one bucket several times.
BUCKET_ROWS = 300_000
#: Orders with more rows take the general way, where a hot order can be split.
ORDER_ROWS = 100_000


@dataclass(frozen=True)
class ByOrder:
    """Report rows in two parts without a common order or line item."""

    #: Rows of orders that hold all rows of their line items; they lie by order.
    closed: DataFrame
    #: All other rows.
    others: DataFrame
    #: The orders of ``others``, as far as they have an id.
    open_orders: DataFrame


def rows_by_order(raw: DataFrame, about: int = 0, order_rows: int = ORDER_ROWS) -> ByOrder:
    """Store report rows by order and tell apart the orders that are closed.

    ``about`` is the number of rows, roughly; it only decides on the number of buckets, which
    is that of the shuffle partitions at least.
    The one shuffle here is by line item: its id and a count. The ids of shared line items
    and of open orders are stored, so their file size decides on a broadcast.
    """
    spark = raw.sparkSession
    root = work_dir(spark, "by-order")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about // BUCKET_ROWS))
    rows = _stored(raw, f"{root}/rows", buckets)
    pairs = rows.groupBy("order_id", "line_item_id").agg(F.count(F.lit(1)).alias("_rows"))
    shared = written(
        pairs.groupBy("line_item_id")
        .agg(F.count(F.lit(1)).alias("_orders"))
        .filter("_orders > 1 OR line_item_id IS NULL")
        .select(F.col("line_item_id").alias("_shared")),
        f"{root}/shared",
    )
    sharing = pairs.join(shared, F.col("line_item_id").eqNullSafe(F.col("_shared")), "left_semi")
    large = pairs.groupBy("order_id").agg(F.sum("_rows").alias("_rows")).filter(F.col("_rows") > order_rows)
    opened = written(
        sharing.select("order_id").union(large.select("order_id")).filter("order_id IS NOT NULL").distinct(),
        f"{root}/open",
    )
    without, ordered = rows.filter("order_id IS NULL"), rows.filter("order_id IS NOT NULL")
    others = without.union(ordered.join(opened, "order_id", "left_semi").select(*rows.columns))
    return ByOrder(
        ordered.join(opened, "order_id", "left_anti").select(*rows.columns),
        written(others, f"{root}/others"),
        opened,
    )


def _stored(raw: DataFrame, path: str, buckets: int) -> DataFrame:
    """The rows bucketed by order. Rows that lie by order already are not shuffled again."""
    spark = raw.sparkSession
    name = f"by_order_{uuid.uuid4().hex}"
    with shuffles_removed(spark), dealt_into(spark, buckets):
        (
            raw.repartition(buckets, "order_id")
            .write.format("parquet")
            .options(path=path, compression="zstd")
            .bucketBy(buckets, "order_id")
            .sortBy("order_id", "line_item_id")
            .saveAsTable(name)
        )
    rows = spark.table(name)
    # The scan knows its files and buckets by now; the files of a table with a path stay.
    spark.sql(f"DROP TABLE {name}")
    return rows
