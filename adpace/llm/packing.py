"""Packing: length buckets that waste the least padding, and token-budget batches inside them.

Token counts of all documents give one global histogram over lengths aligned to
``align``. Dynamic programming over it picks the bucket boundaries with the least
padding. Inside a bucket, sequences are numbered across hash shards (counts per
shard, then offsets) and each ``budget // length`` neighbours form a batch, so no
task holds a whole bucket.

Defined results: a document of more than ``max_len`` tokens is cut into pieces of
``max_len``, nothing is dropped. A document without tokens, null text included, gives
one row with null bucket, batch and slot. Rows with equal doc_id are numbered one
after the other; a null doc_id is numbered like any other. Only ``doc_id`` and
``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adpace.llm.common import table
from adpace.scratch import work_dir, written

ALIGN = 8
MAX_LEN = 8192
BUCKETS = 12
BUDGET = 65_536
SHARD_ROWS = 20_000


def token_count(text: Column) -> Column:
    """Runs of ASCII letters, runs of other letters, single digits and single marks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z]++|[^\x00-\x7F]++|[!-~]")), F.lit(0)).cast("bigint")


def token_lengths(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``doc_id, piece, n_tokens``: one row per piece of at most ``max_len`` tokens."""
    counted = docs.select("doc_id", token_count(F.col("text")).alias("total"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / max_len))
    return counted.select("doc_id", "total", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece", F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len)).cast("bigint").alias("n_tokens")
    )


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` lengths, the largest included, that minimise the total padded length.

    ``histogram`` has the number of sequences by aligned length.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    before = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])])
    n = len(lengths)
    # cost[j] of the best split of the first j lengths; the last bucket of the split ends at lengths[j - 1].
    cost = np.concatenate([[0], np.full(n, np.iinfo(np.int64).max // 4)])
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            options = cost[:j] + (before[j] - before[:j]) * lengths[j - 1]
            i = int(options.argmin())
            if options[i] < new[j]:
                new[j], cut[j] = options[i], i
        cost = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            ends.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(ends)


def bucket_of(n_tokens: Column, ends: list[int]) -> Column:
    """The smallest bucket length that holds so many tokens; null for none."""
    out = F.lit(None).cast("bigint")
    for end in reversed(ends):
        out = F.when(n_tokens <= end, F.lit(end).cast("bigint")).otherwise(out)
    return F.when(n_tokens > 0, out)


def pack(
    docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, align: int = ALIGN
) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket_len, batch, slot``, one row per piece."""
    root = work_dir(docs.sparkSession, "packing")
    lengths = written(token_lengths(docs, max_len), f"{root}/lengths")
    aligned = (F.ceil(F.col("n_tokens") / align) * align).cast("bigint")
    # At most max_len / align rows, whatever the input.
    counted = lengths.filter("n_tokens > 0").groupBy(aligned.alias("aligned")).count().collect()
    histogram = {r["aligned"]: r["count"] for r in counted}
    ends = boundaries(histogram, buckets)
    shards = max(1, -(-sum(histogram.values()) // SHARD_ROWS))
    placed = lengths.select(
        "*", bucket_of(F.col("n_tokens"), ends).alias("bucket_len"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"),
    )
    within = Window.partitionBy("bucket_len", "shard").orderBy(F.xxhash64("piece", "doc_id"), "doc_id", "piece", "n_tokens")
    numbered = placed.filter("bucket_len IS NOT NULL").withColumn("row", F.row_number().over(within))
    sizes = placed.filter("bucket_len IS NOT NULL").groupBy("bucket_len", "shard").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("row") - 1
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    packed = numbered.join(offsets, ["bucket_len", "shard"]).select(
        "doc_id", "piece", "n_tokens", "bucket_len",
        F.floor(rank / per_batch).cast("bigint").alias("batch"), F.pmod(rank, per_batch).cast("bigint").alias("slot"),
    )
    none = F.lit(None).cast("bigint")
    empty = lengths.filter("n_tokens = 0").select(
        "doc_id", "piece", "n_tokens", none.alias("bucket_len"), none.alias("batch"), none.alias("slot")
    )
    return packed.unionByName(empty)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
