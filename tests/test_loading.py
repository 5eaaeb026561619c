"""Exports, row hashes, load modes, goals and the stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.operators import loading as L
from adpace.operators.store import create_store, upsert_store
from adpace.scratch import current, work_dir
from adpace.sources import delivery as D
from adpace.sources import seeds
from adpace.sources.tables import coerce_dates, coerce_numeric
from adpace.streaming.reports import report_stream, upsert_stream
from tests import fixtures as X

# One export row and the MD5 of its fields joined by "|".
HEADER = ",".join(c.upper() for c in S.DELIVERY_COLUMNS)
LINE = (
    "4711,Harbour Lights: Autumn Fair,2024-09-02,2024-09-02 06:30:00,2024-10-06,2024-10-06 22:15:00,"
    "81355,Sidebar tall - Club Heron,2024-09-03,2024-09-03 07:00:00,2024-09-28,2024-09-28 21:45:00,"
    "640000,IMPRESSIONS,211300,1904,3120,388250,0.73,Fair skyscraper 2,160x600,Tablet,6,PRICE_PRIORITY,"
    "DELIVERING,Harbour Lights,97450,811,0.0083"
)
LINE_HASH = "e6e778b13c29bfb5aed4f69100b5b62b"


def fields(**changes):
    values = dict(zip(S.DELIVERY_COLUMNS, LINE.split(",")))
    values.update(changes)
    return ",".join(values.values())


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_export_row(spark, tmp_path):
    row = D.read_delivery_report(spark, write(tmp_path / "r.csv", HEADER, LINE)).first()
    assert row.row_hash == LINE_HASH
    assert row.order_start_date == dt.date(2024, 9, 2)
    assert row.order_end_date_time == dt.datetime(2024, 10, 6, 22, 15)
    assert str(row.ad_server_ctr) == "0.0083"
    assert (row.line_item_priority, row.ad_server_impressions) == (6, 97450)


def test_report_schema(spark, tmp_path):
    report = D.read_delivery_report(spark, write(tmp_path / "r.csv", HEADER, LINE))
    assert [(f.name, f.dataType.simpleString()) for f in report.schema.fields] == [
        *S.DELIVERY_FIELDS, ("row_hash", "string"),
    ]


def test_columns_may_be_reordered_and_extra(spark, tmp_path):
    names = list(reversed(S.DELIVERY_COLUMNS)) + ["something_else"]
    values = list(reversed(LINE.split(","))) + ["x"]
    path = write(tmp_path / "r.csv", ",".join(names), ",".join(values))
    row = D.read_delivery_report(spark, path).first()
    assert row.row_hash == LINE_HASH


def test_zeros_around_numbers_do_not_change_the_hash(spark, tmp_path):
    other = fields(
        order_id="004711", line_item_delivery_indicator="0.7300", ad_server_ctr="+0.00830", ad_server_clicks="811.0"
    )
    path = write(tmp_path / "r.csv", HEADER, LINE, other, fields(ad_server_clicks="8110"), fields(ad_server_ctr="0.0"))
    rows = [r.row_hash for r in D.read_delivery_report(spark, path).collect()]
    assert rows[:2] == [LINE_HASH] * 2 and len(set(rows)) == 3
    target = str(tmp_path / "stored")
    assert L.load_report(spark, write(tmp_path / "a.csv", HEADER, LINE), target, mode="upsert").rows == 1
    assert L.load_report(spark, write(tmp_path / "b.csv", HEADER, other), target, mode="upsert").rows == 0


def test_missing_columns_are_all_named(spark, tmp_path):
    names = [c for c in S.DELIVERY_COLUMNS if c not in ("order_id", "creative_name")]
    path = write(tmp_path / "r.csv", ",".join(names), ",".join("x" for _ in names))
    with pytest.raises(ValueError, match="order_id, creative_name"):
        D.read_delivery_report(spark, path)


def test_na_tokens_are_missing(spark, tmp_path):
    lines = [fields(device_category_name=t) for t in (*S.NA_TOKENS, '""', "na", "Null")]
    rows = D.read_delivery_report(spark, write(tmp_path / "r.csv", HEADER, *lines))
    missing = rows.filter("device_category_name IS NULL")
    assert missing.count() == len(S.NA_TOKENS) + 1
    assert missing.select("row_hash").distinct().count() == 1
    kept = rows.filter("device_category_name IS NOT NULL")
    assert {r.device_category_name for r in kept.collect()} == {"na", "Null"}


def test_quotes_padding_and_separators_survive(spark, tmp_path):
    line = fields(order_name='"A ""b"", c"', rendered_creative_size="  ")
    row = D.read_delivery_report(spark, write(tmp_path / "r.csv", HEADER, line)).first()
    assert (row.order_name, row.rendered_creative_size) == ('A "b", c', "  ")


def test_line_break_in_a_field(spark, tmp_path):
    path = write(tmp_path / "r.csv", HEADER, fields(order_name='"A\nb"'))
    with pytest.raises(Exception):
        D.read_delivery_report(spark, path).collect()
    row = D.read_delivery_report(spark, path, multi_line=True).first()
    assert row.order_name == "A\nb"


def test_whole_numbers(spark, tmp_path):
    path = write(tmp_path / "r.csv", HEADER, fields(ad_server_impressions="500000.0"))
    assert D.read_delivery_report(spark, path).first().ad_server_impressions == 500000
    for bad in ("12.5", "many"):
        path = write(tmp_path / f"{bad}.csv", HEADER, fields(ad_server_impressions=bad))
        with pytest.raises(Exception):
            D.read_delivery_report(spark, path).collect()


def test_latest_report(spark, tmp_path):
    assert D.latest_report(spark, str(tmp_path)) is None
    for age, name in enumerate(
        ("gam_report_b.CSV", "gam_report_a.csv", "other_report.csv", "gam_report_c.txt")
    ):
        write(tmp_path / name, HEADER, LINE)
        moment = 1_700_000_000 + age * (1 if name.endswith("csv") else -1)
        os.utime(tmp_path / name, (moment, moment))
    assert D.latest_report(spark, str(tmp_path)).endswith("gam_report_a.csv")


def stored(spark, target):
    return spark.read.parquet(current(spark, target))


def test_replace_append_and_validate(spark):
    target = work_dir(spark, "stored")
    report = X.report(spark, dict(order_id=1), dict(order_id=2))
    assert L.load_rows(report, target, "validate") == L.LoadResult("validate", 2)
    assert not os.path.exists(target)
    assert L.load_rows(report, target) == L.LoadResult("replace", 2)
    assert L.load_rows(report, target, "replace").rows == 2
    assert stored(spark, target).count() == 2
    with pytest.raises(ValueError, match="append repeats row_hash"):
        L.load_rows(report, target, "append")
    assert stored(spark, target).count() == 2
    assert L.load_rows(X.report(spark, dict(order_id=3)), target, "append").rows == 1
    assert L.load_rows(report, target, "append", enforce_unique=False).rows == 2
    assert stored(spark, target).count() == 5
    with pytest.raises(ValueError, match="mode"):
        L.load_rows(report, target, "merge")


def test_append_rejects_duplicates_within_a_batch(spark):
    row = dict(order_id=1)
    with pytest.raises(ValueError, match="append repeats"):
        L.load_rows(X.report(spark, row, row), work_dir(spark, "stored"), "append")


def test_failing_replace_keeps_the_stored_rows(spark, tmp_path):
    target = work_dir(spark, "stored")
    L.load_rows(X.report(spark, dict(order_id=1)), target)
    path = write(tmp_path / "r.csv", HEADER, LINE, fields(ad_server_impressions="many"))
    with pytest.raises(Exception):
        L.load_report(spark, path, target)
    assert stored(spark, target).count() == 1


def test_upsert_is_idempotent_and_adds_restated_rows(spark):
    target = work_dir(spark, "stored")
    first = X.report(spark, dict(order_id=1), dict(order_id=1), dict(order_id=2))
    assert L.load_rows(first, target, "upsert").rows == 2
    assert L.load_rows(first, target, "upsert").rows == 0
    restated = X.report(spark, dict(order_id=2), dict(order_id=2, ad_server_impressions=101))
    assert L.load_rows(restated, target, "upsert").rows == 1
    assert sorted(r.ad_server_impressions for r in stored(spark, target).collect()) == [100, 100, 101]


def test_bucketed_store_does_not_shuffle_what_is_stored(spark):
    table, buckets = "report_store", 4
    create_store(spark, table, buckets, path=work_dir(spark, "store"))
    report = X.report(spark, *[dict(order_id=i) for i in range(20)])
    old = report.filter("order_id < 5")
    assert upsert_store(old.unionByName(old), table, buckets).rows == 5
    assert upsert_store(report, table, buckets).rows == 15
    assert upsert_store(report, table, buckets).rows == 0
    assert spark.table(table).count() == 20
    plan = L.new_rows(report, spark.table(table))._jdf.queryExecution().executedPlan().toString()
    stored_side = plan.split("LeftAnti")[-1].split("hashpartitioning(row_hash")[-1]
    assert "Bucketed: true" in stored_side


def test_a_large_upsert_meets_the_store_in_slices(spark, monkeypatch):
    """Never more than a part of a large batch is dealt by hash at once; the store grows in one write."""
    from adpace.operators import store

    table, buckets, path = "sliced_store", 4, work_dir(spark, "store")
    create_store(spark, table, buckets, path=path)
    report = X.report(spark, *[dict(order_id=i) for i in range(400)])
    dealt, new_rows = [], store.new_rows
    monkeypatch.setattr(store, "new_rows", lambda batch, known: dealt.append(batch.count()) or new_rows(batch, known))
    monkeypatch.setattr(store, "SLICE_ROWS", 50)
    old = report.filter("order_id < 100")
    root = os.path.dirname(path.removeprefix("file:"))
    files = lambda: [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    before = len(files())
    assert upsert_store(old.unionByName(old), table, buckets).rows == 100
    assert upsert_store(report.unionByName(report), table, buckets).rows == 300
    assert len(files()) - before <= 2 * buckets
    assert upsert_store(report, table, buckets).rows == 0
    assert len(dealt) == 3 * store.SLICES and max(dealt) < 400 and sum(dealt) == 200 + 800 + 400
    rows = spark.table(table)
    assert rows.count() == 400 and rows.select("row_hash").distinct().count() == 400
    assert not [f for f in os.listdir(root) if f.startswith(("upsert-", "merged-"))]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("merged_")]


def test_stores_have_buckets_for_their_rows(spark, monkeypatch):
    from registry import queries as Q

    monkeypatch.setattr(Q, "BUCKET_ROWS", 500)
    t = Q.Tables(spark, "/root/testdata/sf0.001")
    table, buckets = t.new_store()
    assert buckets == -(-t.raw.count() // 500) > Q.STORE_BUCKETS
    assert f"Num Buckets', '{buckets}'" in str([(r.col_name, r.data_type) for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()])


def test_stream_loads_overlapping_drops_once(spark, tmp_path):
    drops, target = tmp_path / "drops", work_dir(spark, "stored")
    drops.mkdir()
    checkpoint = work_dir(spark, "stream")
    write(drops / "gam_report_1.csv", HEADER, LINE, LINE)
    for name, lines in (
        (None, ()),
        ("gam_report_2.csv", (LINE, fields(ad_server_clicks="1501"))),
        ("gam_report_3.csv", (LINE,)),
    ):
        if name:
            write(drops / name, HEADER, *lines)
        rows = report_stream(spark, str(drops), max_files=1)
        upsert_stream(rows, target, checkpoint).awaitTermination()
    got = stored(spark, target)
    assert sorted(r.ad_server_clicks for r in got.collect()) == [811, 1501]
    assert LINE_HASH in {r.row_hash for r in got.collect()}


def test_a_stream_starts_on_an_empty_folder_and_fills_a_store(spark, tmp_path):
    drops, checkpoint = tmp_path / "drops", work_dir(spark, "stream")
    drops.mkdir()
    for clicks in ("811", "812"):
        rows = report_stream(spark, str(drops), multi_line=True)
        upsert_stream(rows, "streamed_store", checkpoint, buckets=4).awaitTermination()
        write(drops / f"gam_report_{clicks}.csv", HEADER, fields(order_name='"A\nb"', ad_server_clicks=clicks))
    rows = report_stream(spark, str(drops), multi_line=True)
    upsert_stream(rows, "streamed_store", checkpoint, buckets=4).awaitTermination()
    got = spark.table("streamed_store").collect()
    assert sorted(r.ad_server_clicks for r in got) == [811, 812] and {r.order_name for r in got} == {"A\nb"}
    with pytest.raises(ValueError, match="only upserts"):
        L.load_rows(rows, "streamed_store", "append", buckets=4)


def test_goal_seed(spark, tmp_path):
    path = write(
        tmp_path / "g.csv", " ORDER_NAME,Advertiser_Name ,IMPRESSION_GOAL,note", "A,X,100.9,n", "B,Y,1e3,n"
    )
    got = {r.order_name: r.impression_goal for r in seeds.read_goals(spark, path).collect()}
    assert got == {"A": 100, "B": 1000}
    missing = write(tmp_path / "m.csv", "order_name,advertiser_name,impression_goal", "A,X,")
    with pytest.raises(Exception, match="no goal for order A"):
        seeds.read_goals(spark, missing).collect()
    assert seeds.read_goals(spark, missing, strict=False).first().impression_goal is None
    text = write(tmp_path / "t.csv", "order_name,advertiser_name,impression_goal", "A,X,lots")
    with pytest.raises(Exception):
        seeds.read_goals(spark, text).collect()
    with pytest.raises(ValueError, match="advertiser_name, impression_goal"):
        seeds.read_goals(spark, write(tmp_path / "c.csv", "order_name", "A"))


def test_domain_sources(spark, tmp_path):
    path = write(
        tmp_path / "d.csv",
        "ORDER_NAME,ADVERTISER_NAME,LINE_ITEM_NAME,TOP_PRIVATE_DOMAIN,LINE_ITEM_ID,ORDER_ID,AD_SERVER_IMPRESSIONS",
        "O,A,L,a.com,10,1,77",
    )
    row = seeds.read_domain_delivery(spark, path).first()
    assert (row.order_id, row.line_item_id, row.domain_name, row.ad_server_impressions) == (1, 10, "a.com", 77)
    clubs = write(tmp_path / "c.csv", "domain_name,club_name,club_display_name", "a.com,a,Team A")
    assert seeds.read_domain_clubs(spark, clubs).first().club_display_name == "Team A"


def test_goal_edits(spark):
    current = X.goals(spark, (1, 10), (2, 20), (3, None))
    edits = spark.createDataFrame(
        [("ORDER 2", "advertiser 2", "25.9"), ("ORDER 3", "advertiser 3", "30")],
        "order_name string, advertiser_name string, new_goal string",
    )
    got = {r.order_name: r.impression_goal for r in L.apply_goal_edits(current, edits).collect()}
    assert got == {"ORDER 1": 10, "ORDER 2": 25, "ORDER 3": 30}
    no_number = edits.withColumn("new_goal", F.lit("lots"))
    for bad in (no_number, edits.limit(0), edits.unionByName(edits)):
        with pytest.raises(Exception, match="must be numeric|edited twice"):
            L.apply_goal_edits(current, bad).collect()


def test_goal_edits_over_their_own_source(spark):
    target = work_dir(spark, "goals")
    L.load_goals(X.goals(spark, (1, 10), (2, 20)), target)
    edits = spark.createDataFrame(
        [("ORDER 2", "advertiser 2", 25)], "order_name string, advertiser_name string, new_goal int"
    )
    got = L.save_goal_edits(stored(spark, target), edits, target)
    assert sorted(r.impression_goal for r in got.collect()) == [10, 25]
    L.load_goals(X.goals(spark, (3, 30)), target, append=True)
    assert stored(spark, target).count() == 3
    with pytest.raises(Exception):
        L.save_goal_edits(stored(spark, target), edits.withColumn("new_goal", F.lit("x")), target)
    assert stored(spark, target).count() == 3


def test_coercion(spark):
    df = spark.createDataFrame([("1.5", "2025-01-01", "x"), ("abc", "soon", "y")], "n string, d string, k string")
    got = coerce_dates(coerce_numeric(df, ["n", "absent"]), ["d", "absent"]).collect()
    assert [tuple(r) for r in got] == [(1.5, dt.date(2025, 1, 1), "x"), (None, None, "y")]


def test_work_dir_is_under_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "a").startswith(root) and work_dir(spark, "a") != work_dir(spark, "a")


def _scan_metrics(df):
    """Files and rows of each file scan of an executed query, in plan order."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "FileSourceScan" in leaf.nodeName() or "Scan parquet" in leaf.nodeName():
            metrics = leaf.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
    return found


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_a_small_batch_reads_only_what_can_hold_its_hashes(spark, monkeypatch):
    from adpace.operators import store

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    # The upsert's join on the hash keeps the scan bucketed; a bare select would not.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        table, buckets = "pruned_store", 8
        create_store(spark, table, buckets, path=work_dir(spark, "store"))
        report = X.report(spark, *[dict(order_id=i) for i in range(400)])
        assert upsert_store(report, table, buckets).rows == 400
        stored_table = spark.table(table)
        whole = _scan_metrics(stored_table.select("row_hash"))[0]
        batch = X.report(spark, dict(order_id=5), dict(order_id=100_000))
        pruned = store.pruned_store(batch, stored_table).select("row_hash")
        _, rows = _scan_metrics(pruned)[0]
        # Two hashes: at most two buckets, and only the row groups that can hold them.
        assert f"SelectedBucketsCount: 2 out of {buckets}" in _formatted(pruned) and rows < whole[1] / 4
        # A larger batch reads every bucket, and the load adds the same row either way.
        monkeypatch.setattr(store, "PROBE_HASHES", 1)
        everything = store.pruned_store(batch, stored_table).select("row_hash")
        assert _scan_metrics(everything)[0] == whole and f"SelectedBucketsCount: {buckets} out of {buckets}" in _formatted(everything)
        assert upsert_store(batch, table, buckets).rows == 1
        monkeypatch.undo()
        assert upsert_store(batch, table, buckets).rows == 0
        assert spark.table(table).count() == 401
        plan = store.new_rows(batch, store.pruned_store(batch, spark.table(table)))._jdf.queryExecution()
        assert "Bucketed: true" in plan.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_exports_are_compressed_and_read_back(spark, tmp_path):
    from registry.queries import Tables

    report = D.read_delivery_report(spark, write(tmp_path / "r.csv", HEADER, LINE, fields(order_name='"A ""b"", c"')))
    folder = Tables(spark, "unused").write_report(str(tmp_path / "export"), report)
    data = [f.name for f in (tmp_path / "export").iterdir() if f.name.startswith("part-")]
    assert data and all(name.endswith(".csv.gz") for name in data)
    assert sorted(D.read_delivery_report(spark, folder).collect()) == sorted(report.collect())


def test_row_hash_holds_one_number_pattern(spark, tmp_path):
    """Written out for each column, the pattern makes a method too long for the JVM to compile."""
    report = D.read_delivery_text(spark, write(tmp_path / "r.csv", HEADER, LINE))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = report._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("regexp_replace") == 1
