"""Creative-size and line-item views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.functions import metrics as M
from adpace.functions import text as X
from adpace.operators.clubs import filter_advertiser


@dataclass(frozen=True)
class SizeSelection:
    """What the size view is restricted to; ``None`` does not filter."""

    advertiser: str | Column | None = None
    order_label: str | Column | None = None
    line_item_label: str | Column | None = None
    device: str | Column | None = None


def labelled_sizes(sizes: DataFrame) -> DataFrame:
    """Creative sizes with the labels that selectors show."""
    return sizes.withColumns(
        {
            "order_label": X.order_label(F.col("order_name"), F.col("advertiser_name")),
            "line_item_label": X.line_item_label(
                F.col("line_item_name"), F.col("line_item_id")
            ),
        }
    )


def select_sizes(sizes: DataFrame, selection: SizeSelection) -> DataFrame:
    """Creative-size rows of a selection, sizes trimmed, blank ones kept as null."""
    rows = filter_advertiser(labelled_sizes(sizes), selection.advertiser)
    for column, wanted in (
        ("order_label", selection.order_label),
        ("line_item_label", selection.line_item_label),
        ("device_category_name", selection.device),
    ):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    trimmed = F.trim("rendered_creative_size")
    return rows.withColumn("rendered_creative_size", F.when(trimmed != "", trimmed))


def creative_size_share(
    sizes: DataFrame, selection: SizeSelection = SizeSelection()
) -> DataFrame:
    """Share of impressions per creative size within a selection.

    The denominator is the line item's own total if one line item is selected,
    else the selection's impressions. If the selection holds a single order,
    the order-level figures fill in and ``share`` is the order-level one. No
    positive denominator gives no rows.
    """
    rows = select_sizes(sizes, selection)
    has_size = F.col("rendered_creative_size").isNotNull()
    imps = F.coalesce("creative_size_impressions", F.lit(0))

    one_line_item = F.lit(selection.line_item_label is not None)
    item_total = F.max(F.when(has_size, F.col("line_item_total_impressions")))
    selected = F.coalesce(F.sum(F.when(has_size, imps)), F.lit(0))
    # The selection's one row of totals reaches every size as a scalar subquery.
    context = rows.agg(
        F.struct(
            F.when(one_line_item & (item_total > 0), item_total)
            .otherwise(selected)
            .alias("total"),
            (selected != 0).alias("delivered"),
            F.coalesce(F.min("order_id") == F.max("order_id"), F.lit(False)).alias("one_order"),
        ).alias("context")
    ).scalar()

    per_size = (
        rows.filter(has_size)
        .groupBy("rendered_creative_size")
        .agg(
            F.sum(imps).alias("impressions"),
            F.count_distinct("line_item_id").alias("selection_line_items"),
            *[
                F.max(c).alias(c)
                for c in (
                    "order_size_impressions",
                    "order_size_line_items",
                    "order_size_avg_impressions_per_line_item",
                    "size_share_of_order_delivery",
                    "size_pct_of_order_goal",
                )
            ],
        )
        .withColumn("_context", context)
        .filter((F.col("_context.total") > 0) & F.col("_context.delivered"))
    )
    one_order = F.col("_context.one_order")

    def order_level(column: str) -> Column:
        return F.when(one_order, F.col(column)).alias(column)

    share = M.safe_ratio(F.col("impressions"), F.col("_context.total"))
    average = M.safe_ratio(F.col("impressions"), F.col("selection_line_items"))
    return per_size.select(
        "rendered_creative_size",
        "impressions",
        "selection_line_items",
        M.half_even(average, 2).alias("selection_avg_impressions_per_line_item"),
        order_level("order_size_impressions"),
        order_level("order_size_line_items"),
        order_level("order_size_avg_impressions_per_line_item"),
        order_level("size_share_of_order_delivery"),
        order_level("size_pct_of_order_goal"),
        share.alias("impressions_share"),
        F.when(one_order, F.col("size_share_of_order_delivery"))
        .otherwise(share)
        .alias("share"),
    ).orderBy("rendered_creative_size")


def validate_size_shares(
    sizes: DataFrame, selection: SizeSelection = SizeSelection()
) -> DataFrame:
    """One row: do the shares of a selection sum to 1, and how many rows had no size."""
    dropped = (
        select_sizes(sizes, selection)
        .agg(F.count_if(F.col("rendered_creative_size").isNull()))
        .scalar()
    )
    total = F.col("share_sum")
    close = F.abs(total - 1.0) <= S.SHARE_SUM_TOLERANCE * F.greatest(F.abs(total), F.lit(1.0))
    return (
        creative_size_share(sizes, selection)
        .agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share_sum"))
        .withColumns({"sums_to_one": close, "dropped_rows": dropped})
    )


def labelled_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with the order label that the selector shows."""
    return diagnostics.withColumn(
        "order_label", X.order_label(F.col("order_name"), F.col("advertiser_name"))
    )


def line_item_detail(
    diagnostics: DataFrame, advertiser: str | Column | None = None, order_label: str | Column | None = None
) -> DataFrame:
    """The line-item detail table of an advertiser and order, as display text."""
    rows = filter_advertiser(labelled_diagnostics(diagnostics), advertiser)
    if order_label is not None:
        rows = rows.filter(F.col("order_label") == order_label)
    return rows.select(
        "line_item_id",
        "line_item_name",
        "domain_name",
        "device_category_name",
        "rendered_creative_size",
        "line_item_type_name",
        X.thousands_text(F.col("line_item_total_impressions")).alias(
            "line_item_total_impressions"
        ),
        X.thousands_text(F.col("domain_impressions")).alias("domain_impressions"),
        X.ctr_text(F.col("line_item_ctr")).alias("line_item_ctr"),
    )
