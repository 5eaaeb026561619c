"""Column expressions on edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from adpace.functions import bands as B
from adpace.functions import metrics as M
from adpace.functions import text as X
from tests.fixtures import day


def values(spark, schema, rows, **expressions):
    df = spark.createDataFrame(rows, schema)
    result = df.select(*[e.alias(n) for n, e in expressions.items()]).collect()
    names = list(expressions)
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in result]


def test_schedule_days_needs_end_after_start(spark):
    rows = [
        (day("2025-01-01"), day("2025-01-15")),
        (day("2025-01-01"), day("2025-01-01")),
        (day("2025-01-02"), day("2025-01-01")),
        (None, day("2025-01-01")),
        (day("2025-01-01"), None),
    ]
    got = values(spark, "s date, e date", rows, d=M.schedule_days(F.col("s"), F.col("e")))
    assert got == [15, None, None, None, None]


def test_days_elapsed_is_bounded(spark):
    rows = [
        (day("2025-04-10"), day("2025-04-30")),
        (day("2025-05-01"), day("2025-05-20")),
        (day("2025-01-01"), day("2025-01-15")),
        (day("2025-04-20"), day("2025-04-20")),
        (None, day("2025-01-15")),
        (day("2025-01-01"), None),
    ]
    elapsed = M.days_elapsed(F.col("s"), F.col("e"), "2025-04-20")
    assert values(spark, "s date, e date", rows, d=elapsed) == [11, 0, 15, 1, None, None]


def test_per_day_truncates_and_needs_a_window(spark):
    rows = [
        (160000, day("2025-03-01"), day("2025-03-31")),
        (5, day("2025-03-01"), day("2025-03-01")),
        (None, day("2025-03-01"), day("2025-03-31")),
        (5, day("2025-03-02"), day("2025-03-01")),
        (5, None, day("2025-03-01")),
        (-7, day("2025-03-01"), day("2025-03-02")),
    ]
    got = values(
        spark, "n bigint, s date, e date", rows,
        d=M.per_day(F.col("n"), F.col("s"), F.col("e")),
    )
    assert got == [5161, 5, 0, None, None, -3]


def test_pacing_index_is_zero_where_undefined(spark):
    rows = [
        (9, 10, 5, 5, 100),
        (11, 10, 5, 5, 100),
        (5161, 6451, 31, 31, 200000),
        (9, 0, 5, 5, 100),
        (9, 10, 0, 5, 100),
        (9, 10, 5, None, 100),
        (9, 10, 5, 5, 0),
        (9, 10, 5, 5, None),
        (9, 10, 5, 5, -1),
        (None, 10, 5, 5, 100),
    ]
    columns = [F.col(c) for c in "atedg"]
    got = values(
        spark, "a bigint, t bigint, e int, d int, g bigint", rows,
        i=M.pacing_index(columns[0], columns[1], columns[2], columns[3], columns[4]),
    )
    assert got == [0.9, 1.1, 5161 / 6451, 0, 0, 0, 0, 0, 0, 0]


def test_ratios_and_ctr(spark):
    rows = [(3, 4), (1, 0), (1, None), (None, 4), (0, 5), (1, -1)]
    got = values(
        spark, "c bigint, i bigint", rows,
        fraction=M.ctr_fraction(F.col("c"), F.col("i")),
        percent=M.ctr_percent(F.col("c"), F.col("i")),
        rounded=M.ctr_percent_rounded(F.col("c"), F.col("i")).cast("string"),
    )
    assert got == [
        (0.75, 75.0, "75.0000"),
        (None, None, "0.0000"),
        (None, None, "0.0000"),
        (None, None, None),
        (0.0, 0.0, "0.0000"),
        (None, None, "0.0000"),
    ]


def test_rounded_ctr_is_half_up(spark):
    rows = [(1, 800000), (3, 800000), (1, 3), (2, 3)]
    got = values(
        spark, "c bigint, i bigint", rows,
        r=M.ctr_percent_rounded(F.col("c"), F.col("i")).cast("string"),
    )
    assert got == ["0.0001", "0.0004", "33.3333", "66.6667"]


@pytest.mark.parametrize(
    "goal, elapsed, index, status, short",
    [
        (None, 0.5, 1.0, "no_goal", "on_track"),
        (0, 0.5, 0.0, "no_goal", "behind"),
        (-5, 0.5, 0.0, "no_goal", "behind"),
        (10, None, 0.0, "too_early", "behind"),
        (10, 0.0, 0.0, "too_early", "behind"),
        (10, 0.5, None, "unknown", "unknown"),
        (10, 0.5, 0.8999, "behind", "behind"),
        (10, 0.5, 0.9, "on_track", "on_track"),
        (10, 0.5, 1.1, "on_track", "on_track"),
        (10, 0.5, 1.1000001, "ahead", "ahead"),
    ],
)
def test_status_ladders(spark, goal, elapsed, index, status, short):
    got = values(
        spark, "g bigint, p double, i double", [(goal, elapsed, index)],
        full=B.pacing_status(F.col("g"), F.col("p"), F.col("i")),
        short=B.order_pacing_status(F.col("i")),
    )
    assert got == [(status, short)]


def test_ending_soon_and_urgent(spark):
    rows = [
        (day("2025-04-20"), 0.5), (day("2025-04-27"), 0.5), (day("2025-04-28"), 0.5),
        (day("2025-04-19"), 0.5), (None, 0.5), (day("2025-04-21"), 0.9), (day("2025-04-21"), None),
    ]
    got = values(
        spark, "e date, i double", rows,
        soon=B.ending_soon(F.col("e"), "2025-04-20"),
        urgent=B.urgent(F.col("e"), F.col("i"), "2025-04-20"),
    )
    assert got == [
        (True, True), (True, True), (False, False), (False, False), (False, False),
        (True, False), (True, False),
    ]


def test_contribution_bucket(spark):
    got = values(
        spark, "s double", [(None,), (0.25,), (0.2499,), (0.10,), (0.0999,)],
        b=B.contribution_bucket(F.col("s")),
    )
    assert got == [
        "unknown", "major_contributor", "medium_contributor", "medium_contributor",
        "minor_contributor",
    ]


@pytest.mark.parametrize(
    "index, risk, share, status, band",
    [
        (0.95, 0.30, 0.9, "behind", "healthy"),
        (0.9499, 0.30, 0.1, "ahead", "watch"),
        (0.95, 0.31, 0.1, "ahead", "watch"),
        (0.7999, 0.0, 0.1, "ahead", "at_risk"),
        (0.80, 0.60, 0.50, "behind", "watch"),
        (0.80, 0.6001, 0.1, "ahead", "at_risk"),
        (0.90, 0.50, 0.5001, "behind", "at_risk"),
        (0.90, 0.50, 0.5001, "ahead", "watch"),
        (0.90, 0.50, 0.5001, None, "watch"),
        (None, None, 0.9, "behind", "unknown"),
        (float("nan"), None, 0.9, "behind", "unknown"),
        (None, 0.7, None, None, "at_risk"),
        (None, 0.5, None, None, "watch"),
    ],
)
def test_club_health_band(spark, index, risk, share, status, band):
    got = values(
        spark, "i double, r double, s double, t string", [(index, risk, share, status)],
        b=B.club_health_band(F.col("i"), F.col("r"), F.col("s"), F.col("t")),
    )
    assert got == [band]


def test_pinned_last(spark):
    labels = [("Sports league",), ("National SPORTS LEAGUE cup",), ("SportsLeague",), ("Lions",)]
    assert values(spark, "l string", labels, p=B.pinned_last(F.col("l"))) == [1, 1, 1, 0]


def test_labels(spark):
    got = values(
        spark, "o string, a string, i bigint", [("A", "B", 1), (None, "B", 2)],
        order=X.order_label(F.col("o"), F.col("a")),
        item=X.line_item_label(F.col("o"), F.col("i")),
    )
    assert got == [("A — B", "A (1)"), ("None — B", "None (2)")]


def test_number_texts_match_python(spark):
    rng = random.Random(7)
    numbers = [0.0, 0.125, 0.375, 2.675, 1.005, 0.5, 1.0, 12.345, 0.0005, 123.4565, 1e-9]
    numbers += [rng.random() * 10 ** rng.randint(-3, 4) for _ in range(300)]
    numbers += [rng.randint(0, 4000) / 1000 for _ in range(300)]
    got = values(
        spark, "x double", [(n,) for n in numbers],
        percent=X.percent_text(F.col("x")),
        index=X.index_text(F.col("x"), ""),
        whole=X.thousands_text(F.col("x")),
        ctr=X.ctr_text(F.col("x")),
        rounded=M.half_even(F.col("x"), 2),
    )
    import numpy as np

    for n, texts in zip(numbers, got):
        ctr = f"{n * 100.0:.2f}%" if n <= 1 else f"{n:.2f}%"
        assert texts == (f"{n * 100.0:.1f}%", f"{n:.2f}", f"{int(n):,}", ctr, float(np.round(n, 2)))


def test_missing_number_texts(spark):
    got = values(
        spark, "x double", [(None,)],
        percent=X.percent_text(F.col("x")),
        index=X.index_text(F.col("x"), "0.00"),
        whole=X.thousands_text(F.col("x")),
        ctr=X.ctr_text(F.col("x")),
    )
    assert got == [("0.0%", "0.00", "0", "-")]
