"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpace import schema as S
from adpace.functions import text as X
from adpace.operators import clubs as C
from adpace.operators import facts, marts, rollups
from adpace.operators import orders as O
from adpace.operators import sizes as Z
from adpace.operators.loading import (
    apply_goal_edits,
    load_goals,
    load_report,
    new_rows,
)
from adpace.operators.placement import ByOrder, rows_by_order
from adpace.operators.quality import (
    ACCEPTED_VALUES,
    NOT_NULL,
    RELATIONSHIPS,
    UNIQUE,
    Check,
    run_checks,
)
from adpace.operators.store import BUCKET_ROWS, create_store, upsert_store
from adpace.plans import warehouse
from adpace.plans.checks import declared_checks
from adpace.scratch import discarded, placed_joins, shuffles_removed, work_dir, written
from adpace.sources import retail, seeds
from adpace.sources.delivery import (
    latest_report,
    read_delivery_report,
    with_row_hash,
)
from adpace.sources.tables import coerce_dates, coerce_numeric, read_mart
from adpace.streaming.reports import report_stream, upsert_stream

Query = Callable[[SparkSession, str], DataFrame]

# The club vocabulary of the retail mapping.
CLUBS = [f"club_{i}" for i in range(12)]

ORDER_COLUMNS = [
    "order_id", "order_name", "advertiser_name", "order_start_date", "order_end_date",
    "order_start_date_time", "order_end_date_time", "order_lifetime_impressions",
    "order_lifetime_clicks", "ad_server_impressions", "ad_server_clicks",
    "order_delivery_status_name",
]

# What the creative-size fact takes from the report.
SIZE_COLUMNS = [
    "order_id", "order_name", "advertiser_name", "order_start_date", "order_end_date",
    "order_start_date_time", "order_end_date_time", "order_delivery_status_name",
    "line_item_id", "line_item_name", "line_item_priority", "line_item_type_name",
    "rendered_creative_size", "device_category_name", "ad_server_impressions", "ad_server_clicks",
]

# What the diagnostics take from the report, and the most rows of an order whose line items
# meet its domain rows by the order alone.
ITEM_COLUMNS = [
    "order_id", "line_item_id", "line_item_start_date", "line_item_end_date",
    "line_item_start_date_time", "line_item_end_date_time",
    "line_item_primary_goal_units_absolute", "line_item_primary_goal_unit_type_name",
    "line_item_lifetime_impressions", "line_item_lifetime_clicks",
    "line_item_delivery_indicator", "line_item_priority", "line_item_type_name",
    "order_delivery_status_name", "creative_name", "rendered_creative_size",
    "device_category_name", "ad_server_impressions", "ad_server_clicks",
]
FEW_ROWS = 1000


class Tables:
    """The delivery model over one set of given tables; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return retail.delivery(self.spark, self.sf_dir)

    @cached_property
    def report_path(self) -> str:
        return work_dir(self.spark, "report")

    @cached_property
    def report(self) -> DataFrame:
        """The raw rows, stored, for queries that export them more than once."""
        return written(self.raw, self.report_path)

    def drop_report(self) -> None:
        """Remove the stored raw rows, once no later step reads them."""
        discarded(self.spark, self.report_path)

    @cached_property
    def goals(self) -> DataFrame:
        return retail.goals(self.spark, self.sf_dir)

    @cached_property
    def domains(self) -> DataFrame:
        return retail.domain_delivery(self.spark, self.sf_dir)

    @cached_property
    def clubs(self) -> DataFrame:
        return retail.domain_clubs(self.spark, self.sf_dir)

    @cached_property
    def inputs(self) -> warehouse.Inputs:
        """The inputs as stored tables, which is what a build starts from."""
        derived = warehouse.Inputs(self.raw, self.goals, self.domains, self.clubs)
        return warehouse.store_inputs(derived, self.inputs_path)

    @cached_property
    def inputs_path(self) -> str:
        return work_dir(self.spark, "inputs")

    @property
    def delivery_path(self) -> str:
        """Where the report of ``inputs`` lies."""
        return f"{self.inputs_path}/delivery"

    def stored_rollups(self, root: str) -> dict[str, DataFrame]:
        """The rollups of the stored report, which goes: no later step of a build reads it."""
        rolled = warehouse.store_rollups(self.inputs.delivery, root)
        discarded(self.spark, self.delivery_path)
        return rolled

    @cached_property
    def orders(self) -> DataFrame:
        return rollups.order_rollup(
            retail.delivery(self.spark, self.sf_dir, ORDER_COLUMNS)
        )

    @cached_property
    def line_items(self) -> DataFrame:
        return rollups.line_item_rollup(self.raw)

    @cached_property
    def sizes(self) -> DataFrame:
        return rollups.creative_size_rollup(self.raw)

    @cached_property
    def health(self) -> DataFrame:
        return facts.order_health(self.orders, self.goals, retail.AS_OF)

    @cached_property
    def pacing(self) -> DataFrame:
        return marts.order_pacing_summary(self.health)

    @cached_property
    def enriched(self) -> DataFrame:
        return O.enrich_orders(self.pacing, retail.AS_OF)

    @cached_property
    def club_delivery(self) -> DataFrame:
        return facts.club_delivery(self.domains, self.clubs, self.health)

    @cached_property
    def portfolio(self) -> DataFrame:
        return marts.club_portfolio(self.club_delivery, retail.AS_OF)

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Domain rows of closed orders meet line items where both lie by order; others the general way.

        As many buckets as shuffle partitions: domain rows are dealt by order into those.
        """
        raw = retail.delivery(self.spark, self.sf_dir, ITEM_COLUMNS)
        rows = rows_by_order(raw, order_rows=FEW_ROWS)
        opened, columns = rows.open_orders, self.domains.columns

        def fact(part: DataFrame, domains: DataFrame, health: DataFrame, by_order: bool) -> DataFrame:
            line_items = rollups.line_item_rollup(part, by_order, facts.DIAGNOSTIC_ITEM_COLUMNS)
            return facts.line_item_diagnostics(domains, line_items, self.clubs, health, by_order)

        if opened.isEmpty():
            return fact(rows.closed, self.domains, self.health, True)
        health = written(self.health, work_dir(self.spark, "health"))
        closed = self.domains.join(opened, "order_id", "left_anti").select(*columns)
        sharing = self.domains.join(opened, "order_id", "left_semi").select(*columns)
        return fact(rows.closed, closed, health, True).union(fact(rows.others, sharing, health, False))

    def rows_by_order(self, columns: list[str]) -> ByOrder:
        """The raw rows stored by order, a row of which is a line item of the given tables."""
        about = retail.table(self.spark, self.sf_dir, "lineitem").count()
        return rows_by_order(retail.delivery(self.spark, self.sf_dir, columns), about)

    @cached_property
    def creative_sizes(self) -> DataFrame:
        """The stored creative-size fact: of the rows that lie by order, and of the others."""
        root = work_dir(self.spark, "creative_sizes")
        rows = self.rows_by_order(SIZE_COLUMNS)
        context = self.health.select("order_id", "reported_impressions", "impression_goal")
        health = written(context, f"{root}/health")

        def fact(part: DataFrame, by_order: bool) -> DataFrame:
            sizes = rollups.creative_size_rollup(part, by_order)
            line_items = rollups.line_item_rollup(part, by_order, facts.SIZE_ITEM_COLUMNS)
            return facts.creative_sizes(sizes, line_items, health, by_order)

        with placed_joins(self.spark):
            closed = written(fact(rows.closed, True), f"{root}/closed")
        return closed.union(written(fact(rows.others, False), f"{root}/others"))

    @cached_property
    def stored_portfolio(self) -> DataFrame:
        """The portfolio over a stored club fact, for views that read it repeatedly."""
        fact = written(self.club_delivery, work_dir(self.spark, "club_delivery"))
        return marts.club_portfolio(fact, retail.AS_OF)

    def top_advertiser(self) -> F.Column:
        """The advertiser with the most delivered impressions, as a scalar subquery."""
        by_advertiser = self.orders.groupBy("advertiser_name").agg(
            F.sum("impressions").alias("total")
        )
        order = F.struct("total", "advertiser_name")
        return by_advertiser.agg(F.max_by("advertiser_name", order)).scalar()

    def top_order_label(self) -> F.Column:
        """The label of the order with the most impressions, as a scalar subquery."""
        label = X.order_label(F.col("order_name"), F.col("advertiser_name"))
        order = F.struct("impressions", "order_id")
        return self.orders.agg(F.max_by(label, order)).scalar()

    def top_club(self) -> F.Column:
        """The club with the most delivered impressions, as a scalar subquery."""
        totals = C.club_delivery_scale(self.stored_portfolio)
        order = F.struct("club_total", "club_display_name")
        return totals.agg(F.max_by("club_display_name", order)).scalar()

    def new_store(self) -> tuple[str, int]:
        """An empty report store of its own, with buckets for the rows of the given tables."""
        path = work_dir(self.spark, "store")
        table = f"report_store_{path.rsplit('-', 1)[1]}"
        about = retail.table(self.spark, self.sf_dir, "lineitem").count()
        buckets = max(STORE_BUCKETS, -(-about // BUCKET_ROWS))
        create_store(self.spark, table, buckets, path=path)
        return table, buckets

    def write_report(self, directory: str, rows: DataFrame | None = None) -> str:
        """Export report rows as CSV, with upper-case headers and an extra column."""
        text = (rows if rows is not None else self.raw).select(
            *[F.col(c).cast("string").alias(c.upper()) for c in S.DELIVERY_COLUMNS],
            F.lit("n/a").alias("EXTRA_COLUMN"),
        )
        _write_csv(text, directory)
        return directory


def _write_csv(df: DataFrame, directory: str) -> None:
    """A CSV export, compressed: report text is many times larger than what it holds.

    One task reads a compressed file, so an export has files of ``EXPORT_ROWS`` rows at most.
    """
    with shuffles_removed(df.sparkSession):
        df.write.mode("append").options(
            header="true",
            escape='"',
            compression="gzip",
            maxRecordsPerFile=EXPORT_ROWS,
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        ).csv(directory)


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the one number type that both engines hash alike."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


STORE_BUCKETS = 8
EXPORT_ROWS = 500_000

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


# --- sources and loading ----------------------------------------------------


@_query
def row_hash(t: Tables) -> DataFrame:
    return with_row_hash(t.raw).select(*S.DELIVERY_COLUMNS, "row_hash")


@_query
def delivery_report_scan(t: Tables) -> DataFrame:
    path = t.write_report(work_dir(t.spark, "export"))
    return read_delivery_report(t.spark, path)


@_query
def validate_report(t: Tables) -> DataFrame:
    path = t.write_report(work_dir(t.spark, "export"))
    result = load_report(t.spark, path, work_dir(t.spark, "stored"), mode="validate")
    checked = read_delivery_report(t.spark, path).agg(
        F.count(F.lit(1)).alias("parsed_rows")
    )
    return checked.withColumn("validated_rows", F.lit(result.rows).cast("bigint"))


def _keys(df: DataFrame) -> DataFrame:
    return df.select("row_hash", "order_id", "line_item_id", "ad_server_impressions")


@_query
def load_replace(t: Tables) -> DataFrame:
    target = work_dir(t.spark, "stored")
    finished = t.report.filter(F.col("order_delivery_status_name") == "Completed")
    load_report(t.spark, t.write_report(work_dir(t.spark, "export"), finished), target)
    load_report(t.spark, t.write_report(work_dir(t.spark, "export"), t.report), target)
    return _keys(read_mart(t.spark, target, ""))


@_query
def load_append(t: Tables) -> DataFrame:
    target, path = work_dir(t.spark, "stored"), t.write_report(work_dir(t.spark, "export"))
    for _ in range(2):
        load_report(t.spark, path, target, mode="append", enforce_unique=False)
    return _keys(read_mart(t.spark, target, ""))


@_query
def load_upsert(t: Tables) -> DataFrame:
    target, buckets = t.new_store()
    finished = t.report.filter(F.col("order_delivery_status_name") == "Completed")
    for rows in (finished, t.report):
        path = t.write_report(work_dir(t.spark, "export"), rows)
        if rows is t.report:
            t.drop_report()  # exported in full: only the export is read from here on
        load_report(t.spark, path, target, mode="upsert", buckets=buckets)
        discarded(t.spark, path)  # loaded: no later step reads the export
    return _keys(t.spark.table(target))


@_query
def upsert_new_rows(t: Tables) -> DataFrame:
    batch = with_row_hash(t.raw)
    stored = batch.filter(F.col("order_delivery_status_name") == "Completed")
    return _keys(new_rows(batch, stored))


@_query
def streaming_upsert(t: Tables) -> DataFrame:
    drops, (target, buckets) = work_dir(t.spark, "drops"), t.new_store()
    finished = t.report.filter(F.col("order_delivery_status_name") == "Completed")
    for rows in (finished, t.report):
        t.write_report(drops, rows)
    t.drop_report()
    rows = report_stream(t.spark, drops, pattern="*.csv.gz")
    upsert_stream(rows, target, work_dir(t.spark, "stream"), buckets).awaitTermination()
    discarded(t.spark, drops)
    return _keys(t.spark.table(target))


@_query
def latest_report_rows(t: Tables) -> DataFrame:
    directory = work_dir(t.spark, "exports")
    finished = t.report.filter(F.col("order_delivery_status_name") == "Completed")
    for name, rows in (("gam_report_a.csv", finished), ("gam_report_b.csv", t.report)):
        t.write_report(f"{directory}/{name}", rows)
    newest = latest_report(t.spark, f"{directory}/*", pattern="*.csv.gz", whole_folder=True)
    report = read_delivery_report(t.spark, newest)
    return report.groupBy("order_delivery_status_name").agg(
        F.count(F.lit(1)).alias("report_rows")
    )


@_query
def goal_seed_scan(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "goals")
    _write_csv(t.goals.toDF(" ORDER_NAME", "Advertiser_Name ", "IMPRESSION_GOAL"), path)
    return seeds.read_goals(t.spark, path)


@_query
def load_goal_seed(t: Tables) -> DataFrame:
    target = work_dir(t.spark, "goals")
    load_goals(t.goals, target)
    return read_mart(t.spark, target, "")


@_query
def domain_club_scan(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "clubs")
    _write_csv(t.clubs, path)
    return seeds.read_domain_clubs(t.spark, path)


@_query
def domain_delivery_scan(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "domains")
    names = [c.upper() for c in t.domains.columns]
    names[names.index("DOMAIN_NAME")] = S.DOMAIN_EXPORT_HEADER.upper()
    _write_csv(t.domains.toDF(*names), path)
    return seeds.read_domain_delivery(t.spark, path)


@_query
def mart_scan(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "marts")
    text = t.pacing.select(*[F.col(c).cast("string").alias(c) for c in t.pacing.columns])
    text.write.parquet(f"{root}/order_pacing_summary")
    stored = read_mart(t.spark, root, "order_pacing_summary")
    typed = coerce_dates(
        coerce_numeric(stored, ["impression_goal", "pacing_index", "order_name"]),
        ["schedule_start_date", "schedule_end_date", "pacing_status"],
    )
    return typed.select(
        "order_id", "impression_goal", "pacing_index", "order_name",
        "schedule_start_date", "schedule_end_date", "pacing_status",
    )


def _edits(t: Tables) -> DataFrame:
    raised = t.goals.filter(F.col("impression_goal") >= 250000)
    return raised.select(
        "order_name", "advertiser_name", (F.col("impression_goal") * 2).alias("new_goal")
    )


@_query
def goal_edits(t: Tables) -> DataFrame:
    return apply_goal_edits(t.goals, _edits(t))


@_query
def refresh_after_goal_edits(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "warehouse")
    t.stored_rollups(root)
    tables = warehouse.refresh_after_goal_edits(
        t.inputs, _edits(t), f"{root}/goals", retail.AS_OF, f"{root}/next", built=root
    )
    return tables["order_pacing_summary"]


def _upsert_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Report rows of a first load, and the rows that a second load adds."""
    done = F.coalesce(F.col("order_delivery_status_name") == "Completed", F.lit(False))
    return t.inputs.delivery.filter(done), t.inputs.delivery.filter(~done)


@_query
def refresh_after_upsert(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "warehouse")
    first, added = _upsert_split(t)
    warehouse.store_rollups(first, root)
    tables = warehouse.refresh_after_upsert(
        t.inputs, added, root, retail.AS_OF, f"{root}/next", spent=[t.delivery_path]
    )
    return tables["club_portfolio"]


@_query
def refresh_aggregate_tables(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "warehouse")
    first, added = _upsert_split(t)
    warehouse.build_aggregate_tables(first, root)
    return warehouse.refresh_aggregate_tables(added, root, f"{root}/next")["delivery_facts"]


@_query
def build_all(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "warehouse")
    warehouse.build_all(t.inputs, retail.AS_OF, root, staged=t.stored_rollups(root))
    return warehouse.open_warehouse(t.spark, root, retail.AS_OF)["club_portfolio"]


@_query
def build_aggregate_tables(t: Tables) -> DataFrame:
    root = work_dir(t.spark, "warehouse")
    return warehouse.build_aggregate_tables(t.raw, root)["delivery_facts"]


# --- rollups ----------------------------------------------------------------


@_query
def order_rollup(t: Tables) -> DataFrame:
    return t.orders


@_query
def line_item_rollup(t: Tables) -> DataFrame:
    return t.line_items


@_query
def creative_size_rollup(t: Tables) -> DataFrame:
    return t.sizes


@_query
def line_items_table(t: Tables) -> DataFrame:
    return rollups.line_items_table(t.raw)


@_query
def orders_table(t: Tables) -> DataFrame:
    return rollups.orders_table(t.raw)


@_query
def delivery_facts(t: Tables) -> DataFrame:
    return rollups.delivery_facts(t.raw)


# --- facts and marts --------------------------------------------------------


@_query
def order_health(t: Tables) -> DataFrame:
    return t.health


@_query
def order_pacing_summary(t: Tables) -> DataFrame:
    return t.pacing


@_query
def first_club_per_domain(t: Tables) -> DataFrame:
    """The club map listed twice, with another club each, as a seed with duplicates."""
    other = t.clubs.select(
        F.upper("domain_name").alias("domain_name"),
        F.concat("club_name", F.lit("_b")).alias("club_name"),
        F.concat("club_display_name", F.lit(" B")).alias("club_display_name"),
    )
    return facts.first_club_per_domain(other.unionByName(t.clubs)).withColumnRenamed(
        "_domain", "domain_name"
    )


@_query
def club_order_agg(t: Tables) -> DataFrame:
    return facts.club_order_agg(facts.domains_with_clubs(t.domains, t.clubs))


@_query
def club_totals(t: Tables) -> DataFrame:
    return facts.club_totals(facts.club_order_agg(facts.domains_with_clubs(t.domains, t.clubs)))


@_query
def club_delivery(t: Tables) -> DataFrame:
    return t.club_delivery


@_query
def club_delivery_unmapped_kept(t: Tables) -> DataFrame:
    """Some domains lose their club: kept rows have a null club and no club share."""
    some = t.clubs.filter(F.col("club_name") != "club_3")
    return facts.club_delivery(t.domains, some, t.health, on_unmapped="keep")


@_query
def club_portfolio(t: Tables) -> DataFrame:
    return t.portfolio


@_query
def line_item_diagnostics(t: Tables) -> DataFrame:
    return t.diagnostics


@_query
def diagnostics_view(t: Tables) -> DataFrame:
    return marts.diagnostics_view(t.diagnostics)


@_query
def order_size_stats(t: Tables) -> DataFrame:
    return facts.order_size_stats(t.sizes)


@_query
def creative_sizes(t: Tables) -> DataFrame:
    return t.creative_sizes


@_query
def creative_sizes_view(t: Tables) -> DataFrame:
    return marts.creative_sizes_view(t.creative_sizes)


# --- order views ------------------------------------------------------------


@_query
def enrich_orders(t: Tables) -> DataFrame:
    return t.enriched.select(
        "order_id", "order_label", "days_to_end", "is_ending_soon", "is_urgent", "pacing_status"
    )


@_query
def filter_orders(t: Tables) -> DataFrame:
    """The default filter: active orders over the whole date range."""
    whole = O.date_preset_range(t.pacing, "all", retail.AS_OF)
    return O.filter_orders(t.enriched, date_range=whole).select(
        "order_id", "order_delivery_status_name", "pacing_status"
    )


@_query
def filter_orders_by_range(t: Tables) -> DataFrame:
    return O.filter_orders(
        t.enriched, delivery_status=None, date_range=("1998-05-01", "1998-06-15")
    ).select("order_id", "schedule_start_date", "schedule_end_date")


@_query
def filter_orders_by_all(t: Tables) -> DataFrame:
    """Advertiser, pacing status, delivery status and a preset range together."""
    return O.filter_orders(
        t.enriched,
        advertiser=t.top_advertiser(),
        pacing_status="behind",
        delivery_status="Completed",
        date_range=O.date_preset_range(t.pacing, "all", retail.AS_OF),
    ).select("order_id", "advertiser_name", "pacing_status", "order_delivery_status_name")


@_query
def date_preset_range(t: Tables) -> DataFrame:
    return O.date_preset_ranges(t.pacing, retail.AS_OF)


@_query
def filter_options(t: Tables) -> DataFrame:
    return O.filter_options(t.pacing, "advertiser_name")


@_query
def filter_options_status(t: Tables) -> DataFrame:
    return O.filter_options(t.pacing, "pacing_status")


@_query
def order_kpis(t: Tables) -> DataFrame:
    return O.order_kpis(t.enriched)


@_query
def active_order_kpis(t: Tables) -> DataFrame:
    return O.order_kpis(O.filter_orders(t.enriched))


@_query
def advertiser_vs_goal(t: Tables) -> DataFrame:
    return O.advertiser_vs_goal(t.pacing)


@_query
def order_pacing_list(t: Tables) -> DataFrame:
    return O.order_pacing_list(t.enriched)


@_query
def order_table(t: Tables) -> DataFrame:
    return O.order_table(t.enriched)


@_query
def spotlight_bottom5(t: Tables) -> DataFrame:
    return O.spotlight(t.enriched)


@_query
def spotlight_top3(t: Tables) -> DataFrame:
    return O.spotlight(t.enriched, best=True)


@_query
def spotlight_club_top3(t: Tables) -> DataFrame:
    return O.spotlight(t.enriched, t.stored_portfolio, t.top_club(), best=True)


@_query
def format_spotlight(t: Tables) -> DataFrame:
    return O.format_spotlight(O.spotlight(t.enriched, best=True))


# --- club views -------------------------------------------------------------


@_query
def club_summary(t: Tables) -> DataFrame:
    digits = {"club_pacing_index": 9, "pacing_weighted_imps": 3}
    return C.club_summary(t.portfolio).withColumns(
        {c: F.round(c, d) for c, d in digits.items()}
    )


@_query
def club_pacing_mix(t: Tables) -> DataFrame:
    return C.rank_clubs(C.club_pacing_mix(t.portfolio), "behind_share")


@_query
def club_delivery_scale(t: Tables) -> DataFrame:
    return C.club_delivery_scale(t.portfolio)


@_query
def urgent_clubs(t: Tables) -> DataFrame:
    return C.urgent_clubs(C.club_summary(t.portfolio)).select(
        "club_name", "club_display_name", "urgent_orders"
    )


@_query
def club_drilldown(t: Tables) -> DataFrame:
    return C.club_drilldown(t.stored_portfolio, urgent_only=True).select(
        "club_display_name", "order_id", "club_delivered_impressions", "is_urgent_order"
    )


@_query
def club_drilldown_by_club(t: Tables) -> DataFrame:
    rows = C.club_drilldown(t.stored_portfolio, advertiser=t.top_advertiser(), club=t.top_club())
    return rows.select("club_display_name", "advertiser_name", "order_id")


def _rounded_share(df: DataFrame) -> DataFrame:
    return df.withColumn("order_share_of_club", F.round("order_share_of_club", 9))


@_query
def order_share_of_club(t: Tables) -> DataFrame:
    return _rounded_share(C.order_share_of_club(t.stored_portfolio))


@_query
def order_share_of_one_club(t: Tables) -> DataFrame:
    return _rounded_share(C.order_share_of_club(t.stored_portfolio, club=t.top_club()))


@_query
def advertiser_club_mix(t: Tables) -> DataFrame:
    return C.advertiser_club_mix(t.portfolio)


# --- size and line-item views -----------------------------------------------


@_query
def creative_size_share(t: Tables) -> DataFrame:
    return Z.creative_size_share(t.creative_sizes)


@_query
def creative_size_share_of_order(t: Tables) -> DataFrame:
    selection = Z.SizeSelection(order_label=t.top_order_label())
    return Z.creative_size_share(t.creative_sizes, selection)


@_query
def creative_size_share_of_line_item(t: Tables) -> DataFrame:
    label = X.line_item_label(F.col("line_item_name"), F.col("line_item_id"))
    order = F.struct("impressions", "line_item_id")
    selection = Z.SizeSelection(
        line_item_label=t.sizes.agg(F.max_by(label, order)).scalar()
    )
    return Z.creative_size_share(t.creative_sizes, selection)


@_query
def creative_size_share_of_device(t: Tables) -> DataFrame:
    selection = Z.SizeSelection(advertiser=t.top_advertiser(), device="R")
    return Z.creative_size_share(t.creative_sizes, selection)


@_query
def validate_size_shares(t: Tables) -> DataFrame:
    return Z.validate_size_shares(t.creative_sizes).withColumn(
        "share_sum", F.round("share_sum", 9)
    )


@_query
def line_item_detail(t: Tables) -> DataFrame:
    return Z.line_item_detail(t.diagnostics)


@_query
def line_item_detail_of_order(t: Tables) -> DataFrame:
    return Z.line_item_detail(t.diagnostics, order_label=t.top_order_label())


# --- quality ----------------------------------------------------------------


@_query
def quality_report(t: Tables) -> DataFrame:
    """All declared checks, on tables built once.

    The report is checked before it goes. The checks of each key column are counted by
    themselves, so that the disk holds their shuffles only.
    """
    root, checks = work_dir(t.spark, "warehouse"), declared_checks(CLUBS)

    def counted(tables: dict[str, DataFrame], some: list[Check]) -> DataFrame:
        return written(run_checks(tables, some), work_dir(t.spark, "checks"))

    of_report = [c for c in checks if c.table == "delivery_report"]
    results = [counted({"delivery_report": with_row_hash(t.inputs.delivery)}, of_report)]
    tables = warehouse.build_all(t.inputs, retail.AS_OF, root, staged=t.stored_rollups(root))
    tables |= {
        "domain_delivery": t.inputs.domains,
        "partner_goals": t.inputs.goals,
        "domain_clubs": t.inputs.clubs,
    }
    groups: dict[str, list[Check]] = {}
    for c in checks:
        if c not in of_report:
            groups.setdefault(c.column if c.kind in (UNIQUE, RELATIONSHIPS) else "", []).append(c)
    results += [counted(tables, some) for some in groups.values()]
    return reduce(DataFrame.unionByName, results)


@_query
def failing_checks(t: Tables) -> DataFrame:
    """Checks that the data does not pass, one of each kind."""
    started = t.orders.filter(F.col("order_delivery_status_name") == "Started")
    return run_checks(
        {"delivery_report": t.raw, "started_orders": started},
        [
            Check(NOT_NULL, "delivery_report", "rendered_creative_size"),
            Check(UNIQUE, "delivery_report", "line_item_id"),
            Check(
                RELATIONSHIPS, "delivery_report", "order_id",
                parent="started_orders", parent_column="order_id",
            ),
            Check(ACCEPTED_VALUES, "delivery_report", "device_category_name", values=("R", "N")),
        ],
    )


@_query
def store_upsert(t: Tables) -> DataFrame:
    """The upsert into a table bucketed by row hash."""
    table, buckets = t.new_store()
    report = with_row_hash(t.report)
    finished = report.filter(F.col("order_delivery_status_name") == "Completed")
    for rows in (finished, report):
        upsert_store(rows, table, buckets)
    t.drop_report()
    return _keys(t.spark.table(table))


def queries() -> dict[str, Query]:
    """All queries by name."""

    def runner(build: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: _plain(build(Tables(spark, sf_dir)))

    return {name: runner(build) for name, build in _QUERIES.items()}
