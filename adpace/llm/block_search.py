"""Approximate nearest neighbours, here made exact: a block matrix join over int8 codes.

Vectors are packed into blocks with one int8 code per component, a scale and the norms
that bound the quantisation error. Query blocks meet candidate blocks by an equi-join on
the block number; a tile's int8 product gives every inner product within a proven bound.
Pairs whose upper bound reaches the running k-th best lower bound are recomputed in
double precision from the original floats, and a heap per query merges them. The heaps
of a query's tiles are merged by rank.

Defined results: a vector takes no part if it is null, all zero, holds a null or a
non-finite component, or has a null vec_id. Rows with equal vec_id count once, with the
smallest vector. Only vectors of equal length meet. Ties go to the smaller vec_id. A
query without candidates has no rows. Only ``vec_id`` and the vector column are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adpace.llm.common import table
from adpace.scratch import work_dir, written

K = 20
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16_384
#: Candidates of a tile are multiplied so many at a time.
STRIP = 2048
QUERY_EVERY = 20

_BLOCK = "dim int, block bigint, n int, ids binary, vectors binary, codes binary, scales binary, norms binary, errors binary"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, vector``: the vectors that take part, one per vec_id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(column)
    part = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    return (
        vectors.filter(part)
        .select("vec_id", v.cast("array<float>").alias("vector"))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors and norms of what rounding lost."""
    exact = vectors.astype(np.float64)
    scales = np.abs(exact).max(axis=1) / 127.0
    scales[scales == 0] = 1.0
    codes = np.rint(exact / scales[:, None]).astype(np.int8)
    decoded = codes * scales[:, None]
    return codes, scales, np.linalg.norm(decoded, axis=1), np.linalg.norm(exact - decoded, axis=1)


def packed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of at most ``block_rows`` vectors of one length, packed where the rows are."""
    schema = pa.schema(
        [("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32())]
        + [(x, pa.binary()) for x in ("ids", "vectors", "codes", "scales", "norms", "errors")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[int, list]]] = {}

        def full(dim: int):
            nonlocal block
            rows = waiting.pop(dim)
            v = np.array([x for _, x in rows], dtype=np.float32)
            codes, scales, norms, errors = quantise(v)
            ids = np.array([i for i, _ in rows], dtype=np.int64)
            block += 1
            row = [[dim], [block], [len(rows)]] + [[a.tobytes()] for a in (ids, v, codes, scales, norms, errors)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for vec_id, vector in zip(*(c.to_pylist() for c in batch.columns)):
                rows = waiting.setdefault(len(vector), [])
                rows.append((vec_id, vector))
                if len(rows) == block_rows:
                    yield full(len(vector))
        for dim in list(waiting):
            yield full(dim)

    return vectors.select("vec_id", "vector").mapInArrow(run, _BLOCK)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


class _Side:
    def __init__(self, row: dict, prefix: str):
        n, dim = row[prefix + "n"], row["dim"]
        read = lambda name, kind: np.frombuffer(row[prefix + name], dtype=kind)
        self.ids = read("ids", np.int64)
        self.vectors = read("vectors", np.float32).reshape(n, dim)
        # Sums of int8 products are exact in float32 up to about a thousand components, and in float64 beyond.
        self.codes = read("codes", np.int8).reshape(n, dim).astype(np.float32 if dim <= 1000 else np.float64)
        self.scales, self.norms, self.errors = (read(x, np.float64) for x in ("scales", "norms", "errors"))


def tile(query: _Side, candidates: _Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query_id, vec_id, score`` of each query's ``k`` nearest within a tile."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query.ids]
    floor = np.full(len(query.ids), -np.inf)
    slack = 1e-9
    for at in range(0, len(candidates.ids), STRIP):
        part = slice(at, at + STRIP)
        rough = (query.codes @ candidates.codes[part].T).astype(np.float64)
        rough *= query.scales[:, None]
        rough *= candidates.scales[part]
        # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |c| <= |c'| + |c - c'|.
        far = candidates.norms[part] + candidates.errors[part]
        bound = query.errors[:, None] * far + query.norms[:, None] * candidates.errors[part] + slack
        own = query.ids[:, None] == candidates.ids[part]
        rough[own] = -np.inf
        low = rough - bound
        if low.shape[1] > k:
            best = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            floor = np.maximum(floor, best)
        rows, columns = np.nonzero((rough + bound >= floor[:, None]) & ~own)
        scores = inner_products(query.vectors[rows], candidates.vectors[part][columns])
        ids = candidates.ids[part][columns]
        for row, score, vec_id in zip(rows.tolist(), scores.tolist(), ids.tolist()):
            heap = heaps[row]
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec_id))
            elif (score, -vec_id) > heap[0]:
                heapq.heapreplace(heap, (score, -vec_id))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    found = [(q, -v, s) for q, heap in zip(query.ids.tolist(), heaps) for s, v in heap]
    columns = list(zip(*found)) or [(), (), ()]
    return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], np.float64)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, column: str = "embedding",
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` candidates of the largest inner product."""
    spark = vectors.sparkSession
    root = work_dir(spark, "block-search")
    part = written(usable(vectors, column), f"{root}/vectors")
    candidates = written(packed(part, candidate_block), f"{root}/candidates")
    queries = written(packed(part.filter(is_query), query_block), f"{root}/queries")
    # One short row per candidate block says which query blocks it meets; each tile is one joined row.
    tiles = candidates.select("dim", F.col("block").alias("c_block")).join(
        queries.select("dim", F.col("block").alias("q_block")), "dim"
    )
    renamed = lambda df, p: df.select("dim", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "dim"])
    joined = (
        tiles.join(renamed(queries, "q").drop("dim"), "q_block")
        .join(renamed(candidates, "c").drop("dim"), "c_block")
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                made = tile(_Side(row, "q_"), _Side(row, "c_"), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)

    hits = joined.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op6_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


#: The same rows in DuckDB.
ORACLE_SQL = """
WITH part AS (
  SELECT vec_id, min(embedding) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS score
  FROM part q JOIN part c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
