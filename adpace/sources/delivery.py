"""Delivery-report exports: scan, missing values, row hash and typing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace import schema as S

ROW_HASH = "row_hash"


def csv_options(multi_line: bool = False) -> dict[str, str]:
    """CSV reader options shared by all exports.

    Nothing is inferred. A record with the wrong number of fields fails the
    scan rather than shift values; so does a quoted line break, unless
    ``multi_line`` reads each file whole. A file whose header differs from the
    first one's fails too.
    """
    return {
        "header": "true",
        "escape": '"',
        "mode": "FAILFAST",
        "enforceSchema": "false",
        "columnPruning": "false",
        "multiLine": str(multi_line).lower(),
    }


def missing_to_null(column: str) -> Column:
    """Null for every text that stands for a missing value."""
    return F.when(~F.col(column).isin(S.NA_TOKENS), F.col(column)).alias(column)


def lower_headers(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_text_csv(
    spark: SparkSession,
    path: str | list[str],
    required: list[str],
    what: str,
    multi_line: bool = False,
) -> DataFrame:
    """The required columns of a CSV export, as text, missing values as null."""
    rows = lower_headers(spark.read.options(**csv_options(multi_line)).csv(path))
    S.require_columns(rows.columns, required, what)
    return rows.select(*[missing_to_null(c) for c in required])


def read_delivery_text(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """A delivery report as text, in the canonical column order, with its row hash."""
    rows = read_text_csv(spark, path, S.DELIVERY_COLUMNS, "delivery report", multi_line)
    return with_row_hash(rows)


def read_delivery_report(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """A typed delivery report with its row hash."""
    return conform_delivery(read_delivery_text(spark, path, multi_line))


def with_row_hash(df: DataFrame) -> DataFrame:
    """MD5 of the report columns as text, joined by ``|``, missing as empty text.

    Numbers count by value: other zeros around them give the same hash.
    """
    held = dict(df.dtypes)
    parts = []
    for name, ddl in S.DELIVERY_FIELDS:
        number = held[name] == "string" and ddl in ("bigint", "int") or ddl.startswith("decimal")
        parts.append(F.struct(F.col(name).cast("string").alias("text"), F.lit(number).alias("number")))
    # One expression for all columns: written out for each, the generated method is too long
    # for the JVM to compile, and every row of a load is interpreted.
    texts = F.transform(
        F.array(*parts),
        lambda part: F.coalesce(F.when(part["number"], number_text(part["text"])).otherwise(part["text"]), F.lit("")),
    )
    return df.withColumn(ROW_HASH, F.md5(F.concat_ws("|", texts)))


def number_text(text: Column) -> Column:
    """A number without a plus, leading zeros or trailing decimal zeros; other text as it is."""
    number = r"^(?:\+|(-))?0*([0-9]+)(?:\.0*|(\.[0-9]*[1-9])0*)?$"
    return F.regexp_replace(F.trim(text), number, "$1$2$3")


def typed(name: str, ddl: str) -> Column:
    """A text column cast to its stored type; a malformed value fails the job.

    Whole numbers may carry a fraction of zeros, as ``500000.0``. Only text
    that does not parse as an integer takes the decimal path.
    """
    value = F.col(name)
    if ddl not in ("bigint", "int"):
        return value.cast(ddl).alias(name)
    number = value.cast("decimal(38,4)")
    problem = F.concat(F.lit(f"{name} is not a whole number: "), value)
    whole = F.when(number == F.floor(number), number.cast(ddl)).otherwise(
        F.raise_error(problem).cast(ddl)
    )
    return F.coalesce(
        value.try_cast(ddl), F.when(value.isNotNull(), whole)
    ).alias(name)


def conform_delivery(text: DataFrame) -> DataFrame:
    """Cast report text to the stored types; a malformed value fails the job."""
    kept = [ROW_HASH] if ROW_HASH in text.columns else []
    return text.select(*[typed(n, t) for n, t in S.DELIVERY_FIELDS], *kept)


def latest_report(
    spark: SparkSession, directory: str, pattern: str = S.REPORT_GLOB, whole_folder: bool = False
) -> str | None:
    """Path of the most recently modified export in a directory, if there is one.

    ``whole_folder`` gives the folder of the newest file, for exports in several parts.
    File contents are not read: only path and modification time are selected.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(directory)
            .select("path", "modificationTime")
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    order = F.struct("modificationTime", "path")
    newest = files.agg(F.max_by("path", order)).first()[0]
    return newest.rsplit("/", 1)[0] if whole_folder and newest else newest
