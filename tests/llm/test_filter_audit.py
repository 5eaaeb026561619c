"""The filter audit against its SQL on edge rows, and its intervals against brute force."""

from itertools import permutations

from adpace.llm import filter_audit
from tests.llm.data import documents, folder, texts
import duckdb

from tests.oracle import differences


def test_intervals_cover_every_order_once():
    by_mask = {}
    for mask, step, first, stop in filter_audit.removal_intervals():
        by_mask.setdefault(mask, []).append((step, first, stop))
    for mask in range(32):
        failed = {x for i, x in enumerate("ABCDE") if mask >> i & 1}
        expected = {}
        for rank, order in enumerate("".join(p) for p in permutations("ABCDE")):
            at = next((s + 1 for s, x in enumerate(order) if x in failed), None)
            if at:
                expected[rank] = at
        got = {r: step for step, first, stop in by_mask.get(mask, []) for r in range(first, stop)}
        assert got == expected


def test_edge_rows_against_sql(spark, tmp_path):
    rows = texts() + [(60, "Word " * 120), (61, "Word " * 120), (None, "Word " * 120), (62, "#" + " w" * 200)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame(
        [(60, 1, 0), (60, 0, 1), (61, None, None), (None, 1, 1), (7, 1, 1)], "doc_id bigint, quality int, toxic int"
    )
    sf = folder(spark, tmp_path, documents=docs.select("doc_id", "text", "lang", "source", "n_chars"), labels=labels)
    result = filter_audit.audit(docs, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    assert differences(con, filter_audit.ORACLE_SQL, result) is None
    parts = {r.lang for r in docs.select("lang").distinct().collect()}
    assert result.count() == 600 * len({p or "" for p in parts})


def test_empty_table(spark):
    empty = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
