"""Where jobs write intermediate tables: the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="adpace-")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder that the session names.

    That is the setting, or else the context's checkpoint folder. Without either
    only a local master gets a temporary folder of its own: on a cluster executors
    would write to disks that the others do not see, so it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup_lock = Lock()
_cleanup_users: list[str | None] = []


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the writes inside go when each write ends.

    Without it they stay until the driver happens to collect its garbage, so the shuffles
    of all steps of a job add up on disk. A write has a plan of its own, which nothing
    runs again. Writes of several threads may overlap: the last one restores the setting.
    """
    with _cleanup_lock:
        _cleanup_users.append(spark.conf.get(SHUFFLE_CLEANUP, None) if not _cleanup_users else _cleanup_users[0])
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleanup_lock:
            before = _cleanup_users.pop()
            if not _cleanup_users:
                spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


#: Bytes that a task of ``small_tasks`` or ``dealt_into`` reads from a shuffle, where Spark takes 64 MB.
TASK_BYTES = 16 << 20
#: Shuffle partitions per usual one from which adaptive execution joins tasks of that size.
FINER = 4
_settings_lock = Lock()
_small_users: list[dict[str, str | None]] = []


@contextmanager
def small_tasks(spark: SparkSession):
    """Writes inside deal their shuffles into tasks of ``TASK_BYTES``.

    For a stage that sorts and aggregates wide rows several times: each of these operators
    holds the task's rows, so its memory is a multiple of what the task reads. Writes of
    several threads may overlap: the last one restores the settings.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(FINER * partitions),
    }
    with _held(spark, wanted, _small_users):
        yield


#: Whether both sides of a join must lie by all its keys, or may lie by some of them.
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_placed_users: list[dict[str, str | None]] = []


@contextmanager
def placed_joins(spark: SparkSession):
    """Writes inside join sides that lie by some of the join's keys without another shuffle.

    For rows that lie by order and join by order and something else. Writes of several
    threads may overlap: the last one restores the setting.
    """
    with _held(spark, {ALL_JOIN_KEYS: "false"}, _placed_users):
        yield


#: Whether Spark may read a bucketed table without its buckets where no operator asks for them.
AUTO_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
_bucket_users: list[dict[str, str | None]] = []


@contextmanager
def bucketed_scans(spark: SparkSession):
    """Writes inside read bucketed tables bucket by bucket, one task for each.

    For rows that go from buckets into the same buckets. Writes of several threads may
    overlap: the last one restores the setting.
    """
    with _held(spark, {AUTO_BUCKETS: "false"}, _bucket_users):
        yield


@contextmanager
def dealt_into(spark: SparkSession, partitions: int):
    """Writes inside deal their shuffles into so many partitions, and read them in small tasks.

    A table bucketed into as many needs no shuffle after a join on its buckets' column.
    Writes of several threads may overlap: the last one restores the setting.
    """
    wanted = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
    }
    with _held(spark, wanted, _small_users):
        yield


@contextmanager
def _held(spark: SparkSession, wanted: dict[str, str], users: list[dict[str, str | None]]):
    """Set ``wanted`` while anyone in ``users`` is inside."""
    with _settings_lock:
        users.append({c: spark.conf.get(c, None) for c in wanted} if not users else users[0])
        for c, value in wanted.items():
            spark.conf.set(c, value)
    try:
        yield
    finally:
        with _settings_lock:
            before = users.pop()
            if not users:
                for c, value in before.items():
                    spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return its scan: later steps no longer depend on its lineage."""
    return written_in_parts([df], path)


def written_in_parts(parts: list[DataFrame], path: str) -> DataFrame:
    """Write parts of a table one after the other, each of which removes its shuffle files, and return its scan."""
    spark = parts[0].sparkSession
    with shuffles_removed(spark):
        for i, part in enumerate(parts):
            part.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def replaced(df: DataFrame, path: str) -> None:
    """Write a table beside ``path`` and put it there once it is whole.

    The old table is set aside by a rename and comes back if the switch fails; a failing
    write leaves it untouched. ``df`` may read ``path`` itself.
    """
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(fresh)
        had_old = files.exists(jvm_path(path))
        if had_old:
            _rename(files, jvm_path(path), jvm_path(old))
        try:
            _rename(files, jvm_path(fresh), jvm_path(path))
        except Exception:
            if had_old:
                _rename(files, jvm_path(old), jvm_path(path))
            raise
        files.delete(jvm_path(old), True)
    finally:
        files.delete(jvm_path(fresh), True)


#: Pointer files of a published table: ``_current-<sequence>``, each naming one version folder.
POINTER = "_current-"
#: Versions that stay after a switch, the current one included.
KEEP_VERSIONS = 2


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    return jvm_path, jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """``(sequence, version folder)`` of the complete pointers at ``path``, newest first."""
    jvm_path, files = _files(spark, path)
    if not files.exists(jvm_path(path)):
        return []
    found = []
    for status in files.listStatus(jvm_path(path)):
        name = status.getPath().getName()
        if not name.startswith(POINTER):
            continue
        stream = files.open(status.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        # A pointer counts once it is whole (it ends in a line break) and its version is complete.
        version = text[:-1]
        if text.endswith("\n") and files.exists(jvm_path(f"{path}/{version}/_SUCCESS")):
            found.append((int(name[len(POINTER):]), version))
    return sorted(found, reverse=True)


def current(spark: SparkSession, path: str) -> str:
    """The folder that readers of ``path`` read: its newest published version, or ``path`` itself."""
    pointers = _pointers(spark, path)
    return f"{path.rstrip('/')}/{pointers[0][1]}" if pointers else path


def published(df: DataFrame, path: str) -> None:
    """Write a table as a new version of ``path`` and switch readers to it at once.

    Steps: the rows go to a version folder of their own; then one small pointer file,
    never written before, names it; then versions beyond ``KEEP_VERSIONS`` are removed.
    Readers (``current``) take the newest whole pointer whose version is complete, so a
    job that fails at any step leaves them the old table or the new one, whole, and a
    rerun cleans what a failed one left. Creating a small file is atomic on object stores
    and a pointer without its closing line break is ignored elsewhere. Two publishers of
    one table cannot take one sequence number: the second create fails. ``df`` may read
    ``path`` itself.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    jvm_path, files = _files(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    _write_version(df, f"{path}/{version}")
    # After every pointer, whole or not: a pointer that a failed job left half written stays unused.
    taken = [int(x.getPath().getName()[len(POINTER):]) for x in files.listStatus(jvm_path(path))
             if x.getPath().getName().startswith(POINTER)]
    sequence = max(taken, default=0) + 1
    _write_pointer(files, jvm_path(f"{path}/{POINTER}{sequence:012d}"), version)
    _expire(spark, path)


def _write_version(df: DataFrame, folder: str) -> None:
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)


def _write_pointer(files, place, version: str) -> None:
    stream = files.create(place, False)
    try:
        stream.write(bytearray(f"{version}\n".encode()))
    finally:
        stream.close()


def _expire(spark: SparkSession, path: str) -> None:
    """Remove versions and pointers beyond the newest ``KEEP_VERSIONS``, and unnamed versions."""
    jvm_path, files = _files(spark, path)
    pointers = _pointers(spark, path)
    kept = {v for _, v in pointers[:KEEP_VERSIONS]}
    oldest = pointers[: KEEP_VERSIONS][-1][0] if pointers else 0
    for status in files.listStatus(jvm_path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            files.delete(status.getPath(), True)
        elif name.startswith(POINTER) and int(name[len(POINTER):]) < oldest:
            files.delete(status.getPath(), False)


def discarded(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of one's own that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _rename(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def all_written(tables: dict[str, tuple[DataFrame | list[DataFrame], str]]) -> dict[str, DataFrame]:
    """Write independent tables, given as ``name: (df, path)`` or ``name: (parts, path)``, one after the other.

    Each has all executors, and its shuffle files go before the next one's come: the disk
    holds the largest table's shuffles, not those of all. The first failure is raised once
    all jobs have ended.
    """
    stored, failures = {}, []
    for name, (df, path) in tables.items():
        try:
            stored[name] = written_in_parts(df, path) if isinstance(df, list) else written(df, path)
        except Exception as e:
            failures.append(e)
    if failures:
        raise failures[0]
    return stored
