"""Building all tables from the four inputs, and refreshing them after goal edits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace.functions.metrics import AsOf
from adpace.operators import facts, marts, rollups
from adpace.operators.loading import save_goal_edits
from adpace.operators.quality import enforce
from adpace.plans.checks import TABLE_CONSTRAINTS
from adpace.scratch import all_written, discarded, work_dir, written
from adpace.sources.tables import read_mart

FACTS = ("order_health", "club_delivery", "line_item_diagnostics", "creative_sizes")
STORED_AGGREGATES = {
    "orders_table": rollups.orders_table,
    "line_items_table": rollups.line_items_table,
    "delivery_facts": rollups.delivery_facts,
}
ROLLUPS = {
    "orders": rollups.order_rollup,
    "line_items": rollups.line_item_rollup,
    "size_rollup": rollups.creative_size_rollup,
}
#: Columns by which each fact is range-clustered and sorted when it is written: a filter on
#: them skips files and row groups by their min/max statistics.
LAYOUT = {
    "order_health": ("advertiser_name", "order_id"),
    "club_delivery": ("club_name", "order_id"),
    "line_item_diagnostics": ("order_id", "line_item_id"),
    "creative_sizes": ("order_id", "line_item_id"),
}


def clustered(df: DataFrame, name: str) -> DataFrame:
    """A fact laid out for data skipping: ranges of its ``LAYOUT`` columns, sorted within files.

    Range partitioning splits a hot first column by the second, so no file gets all of it.
    """
    columns = [c for c in LAYOUT.get(name, ()) if c in df.columns]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df


#: Slices by order in which facts are built when there are more than ``SLICE_ROWS`` line items.
SLICES = 8
SLICE_ROWS = 2_000_000


def order_slices(health: DataFrame, rows: int) -> list[Column]:
    """Conditions on ``order_id``, one of which each row meets: ranges with about as many orders each.

    Every fact joins by order, so a slice of it needs a slice of its inputs only, and the
    disk holds the shuffles of one slice. Few rows are one slice. A hot order makes its
    slice larger.
    """
    order = F.col("order_id")
    if rows <= SLICE_ROWS:
        return [F.lit(True)]
    shares = [k / SLICES for k in range(1, SLICES)]
    cuts = health.agg(F.percentile_approx("order_id", shares, F.lit(10_000))).first()[0] or []
    edges = sorted(set(cuts))
    if not edges:
        return [F.lit(True)]
    between = [(order > low) & (order <= high) for low, high in zip(edges, edges[1:])]
    return [order.isNull() | (order <= edges[0]), *between, order > edges[-1]]


#: The same tables as mergeable rollups, for refreshes after an upsert.
MERGEABLE = {"orders": rollups.ORDERS, "line_items": rollups.LINE_ITEMS, "size_rollup": rollups.SIZES}
MERGEABLE_AGGREGATES = {
    "orders_table": rollups.ORDERS_TABLE,
    "line_items_table": rollups.LINE_ITEMS_TABLE,
    "delivery_facts": rollups.DELIVERY_FACTS,
}


@dataclass(frozen=True)
class Inputs:
    """The four inputs: report rows, goals, domain delivery and the club map."""

    delivery: DataFrame
    goals: DataFrame
    domains: DataFrame
    clubs: DataFrame


def store_inputs(inputs: Inputs, root: str) -> Inputs:
    """Write derived inputs once and return their scans."""
    stored = all_written(
        {f.name: (getattr(inputs, f.name), f"{root}/{f.name}") for f in fields(inputs)}
    )
    return Inputs(**stored)


def store_rollups(delivery: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write the rollups that feed the facts under ``root`` and return their scans."""
    return all_written(
        {n: (build(delivery), f"{root}/rollups/{n}") for n, build in ROLLUPS.items()}
    )


def stored_rollups(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The rollups of an earlier build under ``root``."""
    return {n: spark.read.parquet(f"{root}/rollups/{n}") for n in ROLLUPS}


def build_facts(
    inputs: Inputs,
    as_of: AsOf,
    root: str,
    on_unmapped: str = "error",
    staged: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Write the four facts under ``root`` and return their scans, with the rollups.

    ``root`` should be a new folder per build: readers keep the previous build
    until they switch. The rollups feed several facts, so they are written once,
    also under ``root``; with the rollups of an earlier build as ``staged`` the
    report itself is not read. Facts of many line items are written in slices by order.
    """
    if staged is None:
        staged = store_rollups(inputs.delivery, root)
    line_items, sizes = staged["line_items"], staged["size_rollup"]
    health = written(
        clustered(facts.order_health(staged["orders"], inputs.goals, as_of), "order_health"),
        f"{root}/order_health",
    )
    # The most shuffled first, while the fewest tables are stored.
    others = {
        "creative_sizes": facts.creative_sizes(sizes, line_items, health),
        "line_item_diagnostics": facts.line_item_diagnostics(
            inputs.domains, line_items, inputs.clubs, health
        ),
        "club_delivery": facts.club_delivery(
            inputs.domains, inputs.clubs, health, on_unmapped
        ),
    }
    slices = order_slices(health, line_items.count())
    stored = all_written(
        {n: ([clustered(df.filter(s), n) for s in slices], f"{root}/{n}") for n, df in others.items()}
    )
    return staged | {"order_health": health} | stored


def mart_views(stored: dict[str, DataFrame], as_of: AsOf) -> dict[str, DataFrame]:
    """The four marts as lazy views over the stored facts."""
    return {
        "order_pacing_summary": marts.order_pacing_summary(stored["order_health"]),
        "club_portfolio": marts.club_portfolio(stored["club_delivery"], as_of),
        "diagnostics_view": marts.diagnostics_view(stored["line_item_diagnostics"]),
        "creative_sizes_view": marts.creative_sizes_view(stored["creative_sizes"]),
    }


def build_all(
    inputs: Inputs,
    as_of: AsOf,
    root: str,
    on_unmapped: str = "error",
    register_views: bool = False,
    staged: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Facts as tables under ``root``, marts as views; optionally as temp views too.

    The result also holds the staged rollups, by the names that checks use.
    """
    tables = build_facts(inputs, as_of, root, on_unmapped, staged)
    tables |= mart_views(tables, as_of)
    if register_views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def open_warehouse(spark: SparkSession, root: str, as_of: AsOf) -> dict[str, DataFrame]:
    """Facts stored under ``root`` and the marts over them."""
    stored = {name: read_mart(spark, root, name) for name in FACTS}
    return stored | mart_views(stored, as_of)


def build_aggregate_tables(delivery: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write the stored order, line-item and delivery tables once their constraints hold.

    All are checked as staged and only then published under ``root``.
    """
    stage = work_dir(delivery.sparkSession, "aggregates")
    staged = all_written(
        {n: (build(delivery), f"{stage}/{n}") for n, build in STORED_AGGREGATES.items()}
    )
    for name, df in staged.items():
        enforce(df, name, *TABLE_CONSTRAINTS[name])
    return all_written({n: (df, f"{root}/{n}") for n, df in staged.items()})


def refresh_after_goal_edits(
    inputs: Inputs,
    edits: DataFrame,
    goals_path: str,
    as_of: AsOf,
    root: str,
    on_unmapped: str = "error",
    built: str | None = None,
) -> dict[str, DataFrame]:
    """Persist goal edits at ``goals_path`` and rebuild every table from them.

    Goals do not change a rollup: with ``built``, the folder of a build of the same
    report, its rollups are read instead of the report.
    """
    staged = None if built is None else stored_rollups(inputs.goals.sparkSession, built)
    goals = save_goal_edits(inputs.goals, edits, goals_path)
    edited = Inputs(inputs.delivery, goals, inputs.domains, inputs.clubs)
    return build_all(edited, as_of, root, on_unmapped, staged=staged)


def merged_rollups(added: DataFrame, built: str, root: str) -> dict[str, DataFrame]:
    """The rollups of a build at ``built`` merged with the rollups of ``added`` rows, written under ``root``."""
    old = stored_rollups(added.sparkSession, built)
    return all_written(
        {n: (MERGEABLE[n].merge(old[n], added), f"{root}/rollups/{n}") for n in ROLLUPS}
    )


def refresh_after_upsert(
    inputs: Inputs,
    added: DataFrame,
    built: str,
    as_of: AsOf,
    root: str,
    on_unmapped: str = "error",
    spent: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Every table after an upsert added the report rows ``added`` to the report of ``built``.

    An upsert only inserts, and every rollup is a maximum, minimum or sum: the rollups
    stored at ``built`` merge with those of the added rows, and the facts are built from
    the merged rollups under ``root``. Neither the stored report nor ``inputs.delivery``
    is read; goals, domains and clubs are. Equal to ``build_all`` over all rows.
    ``spent`` names folders of one's own that no step reads after that, such as that of
    the added rows; they are removed before the facts are built.
    """
    staged = merged_rollups(added, built, root)
    for folder in spent:
        discarded(added.sparkSession, folder)
    return build_all(inputs, as_of, root, on_unmapped, staged=staged)


def refresh_aggregate_tables(added: DataFrame, built: str, root: str) -> dict[str, DataFrame]:
    """The stored order, line-item and delivery tables of ``built`` merged with ``added`` rows.

    Checked as staged, as ``build_aggregate_tables`` does, then published under ``root``.
    """
    spark = added.sparkSession
    stage = work_dir(spark, "aggregates")
    staged = all_written(
        {
            n: (table.merge(spark.read.parquet(f"{built}/{n}"), added), f"{stage}/{n}")
            for n, table in MERGEABLE_AGGREGATES.items()
        }
    )
    for name, df in staged.items():
        enforce(df, name, *TABLE_CONSTRAINTS[name])
    return all_written({n: (df, f"{root}/{n}") for n, df in staged.items()})
