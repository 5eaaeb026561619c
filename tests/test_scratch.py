"""Where intermediate tables go, and the safe switch of a stored table."""

import os

import pytest

from adpace import scratch
from adpace.operators import facts
from adpace.sources.delivery import latest_report


class _Context:
    def __init__(self, master, folder):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder


class _Session:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = _Context(master, folder)
        self.conf = {scratch.CHECKPOINT_DIR: setting} if setting else {}


def test_shared_folder():
    assert scratch.work_dir(_Session("yarn", "s3://b/x/"), "p").startswith("s3://b/x/p-")
    assert scratch.work_dir(_Session("yarn", None, "hdfs:/c"), "p").startswith("hdfs:/c/p-")
    assert scratch.work_dir(_Session("local[4]"), "p")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:1"):
        with pytest.raises(ValueError, match="share"):
            scratch.work_dir(_Session(master), "p")


def test_replace_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    scratch.replaced(spark.range(3), target)
    scratch.replaced(spark.read.parquet(target).selectExpr("id + 10 AS id"), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [10, 11, 12]
    with pytest.raises(Exception):
        scratch.replaced(spark.range(3).selectExpr("raise_error('no') AS id"), target)
    rename = scratch._rename

    def failing(files, source, place):
        if ".new-" in source.toString():
            raise OSError("lost")
        rename(files, source, place)

    monkeypatch.setattr(scratch, "_rename", failing)
    with pytest.raises(OSError, match="lost"):
        scratch.replaced(spark.range(1), target)
    assert spark.read.parquet(target).count() == 3
    assert [x for x in os.listdir(tmp_path) if x != "t"] == []


def test_no_folder_has_no_latest_report(spark, tmp_path):
    assert latest_report(spark, str(tmp_path / "none")) is None


def test_a_published_table_is_old_or_new_and_whole_whatever_step_fails(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")

    def read():
        return sorted(r.id for r in spark.read.parquet(scratch.current(spark, target)).collect())

    scratch.published(spark.range(3), target)
    scratch.published(spark.read.parquet(scratch.current(spark, target)).selectExpr("id + 10 AS id"), target)
    assert read() == [10, 11, 12]
    # The version fails while it is written.
    with pytest.raises(Exception):
        scratch.published(spark.range(3).selectExpr("raise_error('no') AS id"), target)
    assert read() == [10, 11, 12]

    # The pointer is cut off while it is written.
    def cut(files, place, version):
        stream = files.create(place, False)
        stream.write(bytearray(version.encode()))
        stream.close()
        raise OSError("lost")

    monkeypatch.setattr(scratch, "_write_pointer", cut)
    with pytest.raises(OSError, match="lost"):
        scratch.published(spark.range(5), target)
    assert read() == [10, 11, 12]
    monkeypatch.undo()

    # Old versions cannot be removed: the new table is already the one read.
    def stuck(*args):
        raise OSError("stuck")

    monkeypatch.setattr(scratch, "_expire", stuck)
    with pytest.raises(OSError, match="stuck"):
        scratch.published(spark.range(2), target)
    assert read() == [0, 1]
    monkeypatch.undo()

    # The next publication leaves the kept versions only.
    scratch.published(spark.range(1), target)
    assert read() == [0]
    assert len([x for x in os.listdir(target) if x.startswith("v-")]) == scratch.KEEP_VERSIONS


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    before = spark.conf.get(scratch.SHUFFLE_CLEANUP)
    with scratch.shuffles_removed(spark):
        with scratch.shuffles_removed(spark):
            assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == "true"
        assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == before


def test_tables_are_written_one_by_one_and_a_failure_spares_the_others(spark, tmp_path, monkeypatch):
    running, most = [], []
    plain = scratch.written

    def watched(df, path):
        running.append(path)
        most.append(len(running))
        try:
            return plain(df, path)
        finally:
            running.remove(path)

    monkeypatch.setattr(scratch, "written", watched)
    bad = spark.range(1).selectExpr("raise_error('no') AS x").selectExpr("CAST(x AS STRING) AS x")
    tables = {"bad": (bad, f"{tmp_path}/bad"), **{f"t{i}": (spark.range(i), f"{tmp_path}/t{i}") for i in range(1, 4)}}
    with pytest.raises(Exception, match="no"):
        scratch.all_written(tables)
    assert max(most) == 1
    assert [spark.read.parquet(f"{tmp_path}/t{i}").count() for i in range(1, 4)] == [1, 2, 3]


def test_the_club_aggregate_runs_in_small_tasks(spark, monkeypatch, tmp_path):
    """Its stage holds a task's rows several times, so it must not join shuffle partitions up to 64 MB."""
    files = {}

    def stored(df, path):
        files[path.rsplit("/", 1)[-1].split("-")[0]] = scratch.written(df, path)
        return spark.read.parquet(path)

    monkeypatch.setattr(facts, "written", stored)
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        domains = spark.range(2000).selectExpr(
            "id AS order_id", "concat('o', id) AS order_name", "id AS line_item_id", "'a' AS advertiser_name",
            "'x.com' AS domain_name", "id AS ad_server_impressions",
        ).repartition("order_id")
        clubs = spark.createDataFrame([("x.com", "c", "C")], "domain_name string, club_name string, club_display_name string")
        health = spark.range(2000).selectExpr(
            "id AS order_id", "'x' AS order_delivery_status_name", *[f"date'2025-01-01' AS schedule_{x}_date" for x in ("start", "end")],
            *[f"timestamp_ntz'2025-01-01' AS schedule_{x}_datetime" for x in ("start", "end")], "1 AS schedule_days",
            "1 AS days_elapsed", "1D AS schedule_pct_elapsed", "1D AS pacing_index", "1L AS reported_impressions",
            "1L AS reported_clicks", "1L AS impression_goal",
        )
        before = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
        got = facts.club_delivery(domains, clubs, health)
        assert got.count() == 2000 and got.agg({"club_delivered_impressions": "sum"}).first()[0] == 1999 * 1000
        assert len(files["per"].inputFiles()) > 4
        assert before == {c: spark.conf.get(c, None) for c in before}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
