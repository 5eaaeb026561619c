"""Line dedup: drop lines whose normalised form occurs in many documents.

Keys of normalised lines are exploded and hashed, distinct documents are counted
per hash, and each document gets the set of its lines to drop back by id. Text is
read twice; only 16-byte hashes and document ids go through the counting shuffles.

Defined results: a null or empty text is one empty line and stays as it is. Rows
with equal doc_id count as one document. A null doc_id counts as one document that
is smaller than any other. Extra columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adpace.llm.common import map_columns, table
from adpace.scratch import work_dir, written

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of an ASCII-lower-cased line without outer white space, if it is long enough."""
    key = line.strip()
    if len(key) < min_chars or not (key.isascii() or len(key.decode()) >= min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``line_hash, line_doc``: each document's distinct long lines."""

    def make():
        def apply(rows):
            hashes, ids = [], []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                # bytes.lower() changes A-Z only.
                keys = {line_key(x, min_chars) for x in (text or b"").lower().split(b"\n")}
                keys.discard(None)
                hashes += keys
                ids += [doc_id] * len(keys)
            return {"line_hash": hashes, "line_doc": ids}

        return apply

    return map_columns(docs.select("doc_id", "text"), make, "line_hash binary, line_doc bigint")


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``line_doc, drop``: the hashes that each document loses, for documents that lose any."""
    spark = docs.sparkSession
    root = work_dir(spark, "line-dedup")
    lines = written(line_hashes(docs, min_chars), f"{root}/lines")
    frequent = written(
        lines.groupBy("line_hash")
        .agg(
            F.count_distinct(F.struct("line_doc")).alias("line_docs"),
            F.max("line_doc").alias("keeper"),
        )
        .filter(F.col("line_docs") >= min_docs)
        .drop("line_docs"),
        f"{root}/frequent",
    )
    lost = lines.join(frequent, "line_hash").filter(~F.col("line_doc").eqNullSafe(F.col("keeper")))
    return written(
        lost.groupBy("line_doc").agg(F.collect_set("line_hash").alias("drop")), f"{root}/drop"
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc`` (every input column, text without the dropped lines), ``n_lines``, ``n_dropped``.

    Lines of at least ``min_chars`` code points whose key occurs in at least
    ``min_docs`` documents stay only in the largest doc_id that holds them.
    """
    drop = lines_to_drop(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    # The drop lists grow with the input, so they are never broadcast; small inputs run as large ones do.
    joined = rows.join(drop.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("line_doc")), "left").select("doc", "drop")
    schema = T.StructType(
        [rows.schema["doc"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            texts = doc.field(at).cast(pa.binary()).to_pylist()
            totals, losses = [], []
            for i, drops in enumerate(batch.column(1).to_pylist()):
                lines = (texts[i] or b"").split(b"\n")
                totals.append(len(lines))
                if not drops:
                    losses.append(0)
                    continue
                gone = set(drops)
                kept = [x for x in lines if line_key(x.lower(), min_chars) not in gone]
                losses.append(len(lines) - len(kept))
                texts[i] = b"\n".join(kept)
            fields = doc.flatten()
            fields[at] = pa.array(texts, pa.binary()).cast(arrow.field("doc").type.field(at).type)
            out = pa.StructArray.from_arrays(fields, fields=list(arrow.field("doc").type))
            yield pa.RecordBatch.from_arrays(
                [out, pa.array(totals, pa.int64()), pa.array(losses, pa.int64())], schema=arrow
            )

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.coalesce("doc.text", F.lit("")), 256)
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256")
    )


#: The same rows in DuckDB.
ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
