"""Dashboard views on edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.operators import clubs as C
from adpace.operators import orders as O
from adpace.operators import sizes as Z
from tests.fixtures import by, day

ORDERS = (
    "order_id bigint, order_name string, advertiser_name string, order_delivery_status_name string, "
    "schedule_start_date date, schedule_end_date date, impression_goal bigint, "
    "delivered_impressions bigint, delivered_impressions_pct_of_goal double, "
    "schedule_pct_elapsed double, pacing_index double, pacing_status string"
)


def order(i, **values):
    row = {
        "order_id": i, "order_name": f"O{i}", "advertiser_name": "A",
        "order_delivery_status_name": "Started",
        "schedule_start_date": day("2025-04-01"), "schedule_end_date": day("2025-04-30"),
        "impression_goal": 100, "delivered_impressions": 50,
        "delivered_impressions_pct_of_goal": 0.5, "schedule_pct_elapsed": 0.5,
        "pacing_index": 1.0, "pacing_status": "on_track",
    } | values
    return tuple(row.values())


def orders(spark, *rows, as_of="2025-04-20"):
    return O.enrich_orders(spark.createDataFrame(list(rows), ORDERS), as_of)


def ids(df):
    return [r.order_id for r in df.collect()]


def test_enrichment(spark):
    rows = orders(
        spark,
        order(1, schedule_end_date=day("2025-04-20"), pacing_status="BEHIND"),
        order(2, schedule_end_date=day("2025-04-27"), pacing_status="on_track"),
        order(3, schedule_end_date=day("2025-04-28"), pacing_status="behind"),
        order(4, schedule_end_date=day("2025-04-19"), pacing_status="behind"),
        order(5, schedule_end_date=None, pacing_status=None, order_name=None),
    )
    got = [
        (r.days_to_end, r.is_ending_soon, r.is_urgent, r.order_label)
        for r in rows.orderBy("order_id").collect()
    ]
    assert got == [
        (0, True, True, "O1 — A"), (7, True, False, "O2 — A"), (8, False, False, "O3 — A"),
        (-1, False, False, "O4 — A"), (None, False, False, "None — A"),
    ]


def test_filters(spark):
    rows = orders(
        spark,
        order(1), order(2, advertiser_name="B"), order(3, pacing_status="ahead"),
        order(4, order_delivery_status_name="Not started"),
        order(5, order_delivery_status_name="Completed"),
        order(6, order_delivery_status_name="DELIVERING"),
        order(7, schedule_start_date=None),
    )
    assert sorted(ids(O.filter_orders(rows))) == [1, 2, 3, 4, 7]
    assert sorted(ids(O.filter_orders(rows, delivery_status=None))) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(O.filter_orders(rows, delivery_status="Completed")) == [5]
    assert ids(O.filter_orders(rows, advertiser="B")) == [2]
    assert ids(O.filter_orders(rows, pacing_status="ahead")) == [3]
    in_april = ("2025-04-30", dt.date(2025, 5, 30))
    assert 7 not in ids(O.filter_orders(rows, date_range=in_april))
    assert 1 in ids(O.filter_orders(rows, date_range=in_april))
    assert ids(O.filter_orders(rows, date_range=("2025-05-01", "2025-05-30"))) == []
    assert ids(O.filter_orders(rows, date_range=("2025-03-01", "2025-03-31"))) == []
    no_start = rows.drop("schedule_start_date")
    assert 7 in ids(O.filter_orders(no_start, date_range=in_april))


def test_date_presets(spark):
    rows = orders(
        spark, order(1, schedule_end_date=day("2025-04-16")), order(2, schedule_end_date=day("2026-01-01"))
    )

    def preset(name, as_of="2025-04-20"):
        return tuple(O.date_preset_range(rows, name, as_of).first())

    assert preset("past_7") == (day("2025-04-16"), day("2025-04-20"))
    assert preset("past_30", "2025-06-01") == (day("2025-05-03"), day("2025-06-01"))
    assert preset("year_to_date", "2027-03-01") == (day("2027-01-01"), day("2026-01-01"))
    assert preset("all") == (day("2025-04-16"), day("2026-01-01"))
    with pytest.raises(ValueError):
        preset("tomorrow")
    empty = O.date_preset_range(rows.limit(0), "past_7", "2025-04-20")
    assert tuple(empty.first()) == (None, None)
    one_row = O.date_preset_range(rows, "all", "2025-04-20")
    assert sorted(ids(O.filter_orders(rows, date_range=one_row))) == [1, 2]


def test_kpis(spark):
    rows = orders(
        spark,
        order(1, pacing_status="behind", schedule_end_date=day("2025-04-21")),
        order(2, pacing_status="On_Track"), order(3, pacing_status="ahead", impression_goal=None),
        order(4, pacing_status="no_goal", impression_goal=0), order(5, pacing_status=None),
    )
    got = O.order_kpis(rows).first()
    assert tuple(got) == (5, 1, 1, 1, 2, 1, 250 * 100 / 300)
    assert O.order_kpis(rows.limit(0)).first().overall_pct_goal == 0.0


def test_advertiser_vs_goal(spark):
    rows = orders(
        spark, order(1, advertiser_name="B", delivered_impressions=None),
        order(2, advertiser_name="A", impression_goal=None), order(3, advertiser_name="A", impression_goal=None),
        order(4, advertiser_name=None),
    )
    got = [tuple(r) for r in O.advertiser_vs_goal(rows).collect()]
    assert got == [("B", 0, 100, 0.0), ("A", 100, 0, None)]
    with pytest.raises(ValueError, match="impression_goal"):
        O.advertiser_vs_goal(rows.drop("impression_goal"))


def test_pacing_list(spark):
    rows = orders(
        spark, order(1, pacing_index=None, pacing_status=None), order(2, pacing_index=1.2, pacing_status="ahead"),
        order(3, pacing_index=0.1, pacing_status="Behind", schedule_end_date=day("2025-04-20")),
        order(4, pacing_index=0.1, pacing_status="behind", impression_goal=None),
    )
    got = [(r.order_id, r.pacing_urgency_band, r.completion_rate) for r in O.order_pacing_list(rows).collect()]
    assert got == [
        (3, "behind_urgent", 0.5), (4, "behind", None), (2, "ahead", 0.5), (1, "unknown", 0.5),
    ]


def test_order_table(spark):
    rows = orders(
        spark, order(1, pacing_status="behind", schedule_end_date=day("2025-04-20"), pacing_index=0.125),
        order(2, delivered_impressions_pct_of_goal=None, schedule_pct_elapsed=None, pacing_index=None),
    )
    table = by(O.order_table(rows), "order_id")
    assert O.order_table(rows).columns[0] == "urgency_flag"
    assert (table[1].urgency_flag, table[2].urgency_flag) == (S.URGENCY_TEXT, "")
    assert (table[1].delivered_impressions_pct_of_goal, table[1].pacing_index) == ("50.0%", "0.12")
    assert tuple(table[2][c] for c in table[2].__fields__[-3:]) == ("0.0%", "0.0%", "0.00")


def test_spotlight(spark):
    rows = orders(spark, *[order(i, pacing_index=None if i == 9 else float(i % 4)) for i in range(10)])
    assert ids(O.spotlight(rows)) == [0, 4, 8, 1, 5]
    assert ids(O.spotlight(rows, best=True)) == [3, 7, 2]
    on_club = spark.createDataFrame([(2, "X"), (2, "X"), (5, "X"), (9, "X"), (3, "Y")], "order_id bigint, club_display_name string")
    assert ids(O.spotlight(rows, on_club, "X")) == [5, 2]
    shown = O.format_spotlight(
        O.spotlight(orders(spark, order(1, delivered_impressions=1234567, impression_goal=None, schedule_pct_elapsed=None)))
    ).first()
    assert tuple(shown) == ("O1", "A", "1.00", "1,234,567", "0", "0.0%")


def test_filter_options(spark):
    rows = orders(spark, order(1, advertiser_name="b"), order(2, advertiser_name=None), order(3, advertiser_name="A"), order(4, advertiser_name="b"))
    assert [r[0] for r in O.filter_options(rows, "advertiser_name").collect()] == ["A", "b"]


CLUBS = (
    "club_name string, club_display_name string, order_id bigint, order_name string, "
    "advertiser_name string, club_delivered_impressions bigint, order_pacing_index double, "
    "order_share_of_club_delivery double, order_pacing_status string, is_urgent_order boolean"
)


def portfolio(spark, *rows):
    return spark.createDataFrame(list(rows), CLUBS)


def sample_portfolio(spark):
    return portfolio(
        spark,
        ("a", "Club A", 1, None, "X", 60, 0.5, 0.6, "behind", True),
        ("a", "Club A", 2, "Two", "Y", 30, 1.0, 0.3, "on_track", False),
        ("a", "Club A", 3, "Three", "X", 10, None, None, None, False),
        ("b", "Club B", 5, "Five", "X", 50, 1.2, 0.5, "ahead", False),
        ("b", "Club B", 4, "Four", "Y", 50, 1.3, 0.5, "ahead", False),
        ("l", "Sports league", 6, "Six", "Z", 500, 1.0, 1.0, "on_track", False),
        ("z", "Club Z", 7, "Seven", "Z", None, 1.0, None, "behind", False),
        (None, "Nobody", 8, "Eight", "Z", 5, 1.0, 1.0, "behind", True),
    )


def test_club_summary(spark):
    got = by(C.club_summary(sample_portfolio(spark)), "club_name")
    assert set(got) == {"a", "b", "l", "z"}
    a = got["a"]
    assert (a.club_total_impressions, a.active_orders, a.urgent_orders) == (100, 3, 1)
    assert (a.imps_from_behind, a.imps_from_on_track, a.imps_from_ahead) == (60, 30, 0)
    assert (a.pacing_imps, a.club_pacing_index) == (90, 60.0 / 90)
    assert (a.top_order_share, a.top_order_pacing_status, a.top_order_name) == (0.6, "behind", "Two")
    assert (a.at_risk_share, a.club_health_band) == (0.6, "at_risk")
    assert (got["b"].top_order_name, got["b"].club_health_band) == ("Four", "healthy")
    z = got["z"]
    assert (z.club_total_impressions, z.club_pacing_index, z.at_risk_share) == (0, 0.0, 0.0)
    assert (z.top_order_share, z.club_health_band) == (None, "at_risk")
    assert [r.club_name for r in C.urgent_clubs(C.club_summary(sample_portfolio(spark))).collect()] == ["a"]


def test_club_mix_and_scale(spark):
    mix = C.club_pacing_mix(sample_portfolio(spark))
    a = {r.order_pacing_status: r for r in mix.filter("club_display_name = 'Club A'").collect()}
    assert {s: (r.club_impressions, r.impression_share) for s, r in a.items()} == {
        "behind": (60, 0.6), "on_track": (30, 0.3), "unknown": (10, 0.1),
    }
    assert {r.behind_share for r in a.values()} == {0.6}
    ranked = [r.club_display_name for r in C.rank_clubs(mix, "behind_share").collect()]
    assert ranked == ["Nobody"] + ["Club A"] * 3 + ["Club B", "Club Z", "Sports league"]
    scale = [tuple(r) for r in C.club_delivery_scale(sample_portfolio(spark)).collect()]
    assert scale == [
        ("Club A", 100), ("Club B", 100), ("Nobody", 5), ("Club Z", 0), ("Sports league", 500),
    ]
    unpinned = C.rank_clubs(C.club_delivery_scale(sample_portfolio(spark)), "club_total", pin_last=False)
    assert unpinned.first().club_display_name == "Sports league"


def test_drilldown(spark):
    rows = sample_portfolio(spark)
    assert sorted(ids(C.club_drilldown(rows, urgent_only=True))) == [1, 2, 3]
    assert sorted(ids(C.club_drilldown(rows, advertiser="X", urgent_only=True))) == [1, 3]
    assert ids(C.club_drilldown(rows, advertiser="Y", urgent_only=True)) == []
    assert sorted(ids(C.club_drilldown(rows, club="Club B"))) == [4, 5]


def test_order_share_of_club(spark):
    got = [tuple(r) for r in C.order_share_of_club(sample_portfolio(spark), advertiser="X").collect()]
    assert [r[0] for r in got] == ["Club B", "Club A", "Club A", "Total"]
    assert [r[4] for r in got] == [100.0, 6000 / 70, 1000 / 70, pytest.approx(200.0)]
    assert got[-1][:4] == ("Total", "", "", 120)
    whole = C.order_share_of_club(sample_portfolio(spark)).collect()
    assert whole[-1].order_share_of_club == pytest.approx(400.0)
    assert C.order_share_of_club(sample_portfolio(spark), club="none").collect()[0].club_delivered_impressions == 0


def test_advertiser_mix(spark):
    got = C.advertiser_club_mix(sample_portfolio(spark), "X").collect()
    assert {r.club_display_name: r.share_of_advertiser for r in got} == {"Club A": 70 / 120, "Club B": 50 / 120}


SIZES = (
    "order_id bigint, order_name string, advertiser_name string, line_item_id bigint, "
    "line_item_name string, device_category_name string, rendered_creative_size string, "
    "creative_size_impressions bigint, line_item_total_impressions bigint, "
    "order_size_impressions bigint, order_size_line_items bigint, "
    "order_size_avg_impressions_per_line_item double, size_share_of_order_delivery double, "
    "size_pct_of_order_goal double"
)


def size_rows(spark, *rows):
    """Rows of (order, line item, device, size, impressions, line-item total)."""
    data = [
        (o, f"O{o}", "A", i, f"L{i}", d, s, n, total, 90, 2, 45.0, 0.9, 0.5)
        for o, i, d, s, n, total in rows
    ]
    return spark.createDataFrame(data, SIZES)


def sample_sizes(spark):
    return size_rows(
        spark,
        (1, 10, "Desktop", "a", 60, 100), (1, 10, "Mobile", " a ", 20, 100),
        (1, 11, "Desktop", "b", 10, 40), (1, 11, "Desktop", "  ", 5, 40),
        (2, 20, "Desktop", "a", 5, 5), (2, 20, None, None, 7, 5), (3, 30, "Desktop", "c", None, None),
    )


def shares(df):
    return {r.rendered_creative_size: (r.impressions, r.share) for r in df.collect()}


def test_size_share_of_everything(spark):
    df = Z.creative_size_share(sample_sizes(spark))
    assert shares(df) == {"a": (85, 85 / 95), "b": (10, 10 / 95), "c": (0, 0.0)}
    row = by(df, "rendered_creative_size")["a"]
    assert (row.selection_line_items, row.selection_avg_impressions_per_line_item) == (2, 42.5)
    assert row.order_size_impressions is None
    check = Z.validate_size_shares(sample_sizes(spark)).first()
    assert (check.share_sum, check.sums_to_one, check.dropped_rows) == (pytest.approx(1.0), True, 2)


def test_size_share_of_one_order(spark):
    selection = Z.SizeSelection(order_label="O1 — A")
    df = Z.creative_size_share(sample_sizes(spark), selection)
    assert shares(df) == {"a": (80, 0.9), "b": (10, 0.9)}
    row = by(df, "rendered_creative_size")["a"]
    assert (row.impressions_share, row.order_size_impressions, row.size_pct_of_order_goal) == (80 / 90, 90, 0.5)
    check = Z.validate_size_shares(sample_sizes(spark), selection).first()
    assert (check.sums_to_one, check.dropped_rows) == (False, 1)


def test_size_share_of_one_line_item_uses_its_total(spark):
    selection = Z.SizeSelection(line_item_label="L10 (10)", device="Desktop")
    row = Z.creative_size_share(sample_sizes(spark), selection).first()
    assert (row.impressions, row.impressions_share, row.share) == (60, 0.6, 0.9)


def test_size_share_without_delivery_is_empty(spark):
    assert Z.creative_size_share(sample_sizes(spark), Z.SizeSelection(order_label="O3 — A")).count() == 0
    assert Z.creative_size_share(sample_sizes(spark), Z.SizeSelection(advertiser="nobody")).count() == 0
    nothing = size_rows(spark, (1, 10, "Desktop", "a", 0, 100))
    assert Z.creative_size_share(nothing, Z.SizeSelection(line_item_label="L10 (10)")).count() == 0
    check = Z.validate_size_shares(nothing).first()
    assert (check.share_sum, check.sums_to_one) == (0.0, False)


def test_line_item_detail(spark):
    rows = spark.createDataFrame(
        [
            (1, "O1", "A", 10, "L", "a.com", "Desktop", "s", "STANDARD", 12345, None, 0.0125),
            (1, "O1", "A", 11, "L", "b.com", "Desktop", "s", "STANDARD", None, 5, None),
            (2, "O2", "B", 20, "L", "b.com", "Desktop", "s", "STANDARD", 1, 5, 1.5),
        ],
        "order_id bigint, order_name string, advertiser_name string, line_item_id bigint, line_item_name string, "
        "domain_name string, device_category_name string, rendered_creative_size string, line_item_type_name string, "
        "line_item_total_impressions bigint, domain_impressions bigint, line_item_ctr double",
    )
    got = by(Z.line_item_detail(rows), "line_item_id")
    assert tuple(got[10])[-3:] == ("12,345", "0", "1.25%")
    assert tuple(got[11])[-3:] == ("0", "5", "-")
    assert tuple(got[20])[-3:] == ("1", "5", "1.50%")
    assert len(Z.line_item_detail(rows).columns) == 9
    assert [r.line_item_id for r in Z.line_item_detail(rows, advertiser="B").collect()] == [20]
    assert Z.line_item_detail(rows, order_label="O1 — A").count() == 2
    assert Z.line_item_detail(rows, advertiser=F.lit("B")).count() == 1
