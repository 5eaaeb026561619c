"""Seeds and the domain export: goals, domain-to-club map, domain delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.sources.delivery import (
    csv_options,
    lower_headers,
    missing_to_null,
    read_text_csv,
    typed,
)


def read_goals(
    spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False
) -> DataFrame:
    """Contracted goals, truncated to whole impressions.

    A goal that is not a number fails. A missing goal fails too if ``strict``,
    which is how goals are loaded; otherwise it stays null.
    """
    rows = read_text_csv(spark, path, S.GOAL_COLUMNS, "goal seed", multi_line)
    return typed_goals(rows, strict)


def typed_goals(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Goals from text rows; see ``read_goals``."""
    goal = F.col("impression_goal")
    number = F.trim(goal).cast("decimal(38,6)").cast("bigint")
    if strict:
        missing = F.concat(F.lit("no goal for order "), F.coalesce("order_name", F.lit("null")))
        number = F.when(goal.isNull(), F.raise_error(missing).cast("bigint")).otherwise(number)
    return rows.select("order_name", "advertiser_name", number.alias("impression_goal"))


def read_domain_clubs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The domain-to-club map."""
    return read_text_csv(spark, path, S.DOMAIN_CLUB_COLUMNS, "domain-club seed", multi_line)


def read_domain_delivery(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Domain delivery; the export's own header for the domain is renamed."""
    rows = lower_headers(spark.read.options(**csv_options(multi_line)).csv(path))
    rows = rows.withColumnRenamed(S.DOMAIN_EXPORT_HEADER, "domain_name")
    names = [n for n, _ in S.DOMAIN_DELIVERY_FIELDS]
    S.require_columns(rows.columns, names, "domain delivery")
    text = rows.select(*[missing_to_null(c) for c in names])
    return text.select(*[typed(n, t) for n, t in S.DOMAIN_DELIVERY_FIELDS])
