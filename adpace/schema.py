"""Names, types and fixed values of the delivery model.

Everything in this module is a fixed value of the data contract: column names,
column order, vocabularies, thresholds and patterns.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 29 columns of a delivery report, in the order that the row
# hash and the stored table use.
DELIVERY_FIELDS: list[tuple[str, str]] = [
    ("order_id", "bigint"),
    ("order_name", "string"),
    ("order_start_date", "date"),
    ("order_start_date_time", "timestamp_ntz"),
    ("order_end_date", "date"),
    ("order_end_date_time", "timestamp_ntz"),
    ("line_item_id", "bigint"),
    ("line_item_name", "string"),
    ("line_item_start_date", "date"),
    ("line_item_start_date_time", "timestamp_ntz"),
    ("line_item_end_date", "date"),
    ("line_item_end_date_time", "timestamp_ntz"),
    ("line_item_primary_goal_units_absolute", "bigint"),
    ("line_item_primary_goal_unit_type_name", "string"),
    ("line_item_lifetime_impressions", "bigint"),
    ("line_item_lifetime_clicks", "bigint"),
    ("order_lifetime_clicks", "bigint"),
    ("order_lifetime_impressions", "bigint"),
    ("line_item_delivery_indicator", "decimal(10,4)"),
    ("creative_name", "string"),
    ("rendered_creative_size", "string"),
    ("device_category_name", "string"),
    ("line_item_priority", "int"),
    ("line_item_type_name", "string"),
    ("order_delivery_status_name", "string"),
    ("advertiser_name", "string"),
    ("ad_server_impressions", "bigint"),
    ("ad_server_clicks", "bigint"),
    ("ad_server_ctr", "decimal(10,4)"),
]
DELIVERY_COLUMNS: list[str] = [name for name, _ in DELIVERY_FIELDS]

# Seed and domain tables.
GOAL_COLUMNS = ["order_name", "advertiser_name", "impression_goal"]
DOMAIN_CLUB_COLUMNS = ["domain_name", "club_name", "club_display_name"]
DOMAIN_DELIVERY_FIELDS: list[tuple[str, str]] = [
    ("order_id", "bigint"),
    ("order_name", "string"),
    ("line_item_id", "bigint"),
    ("line_item_name", "string"),
    ("advertiser_name", "string"),
    ("domain_name", "string"),
    ("ad_server_impressions", "bigint"),
]
# Fixed value: the domain export's own header for the domain column.
DOMAIN_EXPORT_HEADER = "top_private_domain"

# Texts read as missing, the public default list of pandas.read_csv.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Fixed value: file names of delivery exports; the suffix is case-insensitive.
REPORT_GLOB = "gam_report_*.[cC][sS][vV]"

# Status vocabularies.
PACING_STATUSES = ["no_goal", "too_early", "unknown", "behind", "on_track", "ahead"]
ORDER_PACING_STATUSES = ["unknown", "behind", "on_track", "ahead"]
CONTRIBUTION_BUCKETS = [
    "unknown", "major_contributor", "medium_contributor", "minor_contributor",
]
ACTIVE_DELIVERY_STATUSES = ["Started", "Not started"]
CLUB_NAMES = [
    "sportsleague", "teamrabbit", "teamlion", "teameagle", "teamgiants",
    "teambuffalo", "teamdolphins",
]

# Thresholds.
BEHIND_BELOW = 0.9
AHEAD_ABOVE = 1.1
MAJOR_SHARE = 0.25
MEDIUM_SHARE = 0.10
ENDING_SOON_DAYS = 7
HEALTHY_PACING = 0.95
HEALTHY_RISK = 0.30
AT_RISK_PACING = 0.80
AT_RISK_SHARE = 0.60
CONCENTRATED_SHARE = 0.50
SHARE_SUM_TOLERANCE = 1e-3
SPOTLIGHT_BOTTOM = 5
SPOTLIGHT_TOP = 3

# Display texts.
LABEL_SEPARATOR = " — "
MISSING_TEXT = "None"
URGENCY_TEXT = "⚠️ Ending soon & behind"
TOTAL_LABEL = "Total"
LEAGUE_LABEL_PART = "sports league"
LEAGUE_LABEL = "sportsleague"


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(10,4)": T.DecimalType(10, 4),
}


def struct_of(fields: list[tuple[str, str]]) -> T.StructType:
    """A ``StructType`` from ``(name, type)`` pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields])


def text_struct(columns: list[str]) -> T.StructType:
    """A ``StructType`` of strings, for sources that must not infer types."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


DELIVERY_SCHEMA = struct_of(DELIVERY_FIELDS)
DOMAIN_DELIVERY_SCHEMA = struct_of(DOMAIN_DELIVERY_FIELDS)


def require_columns(present: list[str], required: list[str], what: str) -> None:
    """Raise ``ValueError`` naming every required column that is not present."""
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
