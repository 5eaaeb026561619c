"""Filter interaction audit: what five document filters remove in each of their 120 orders.

Each document reduces to the set of filters it fails (a mask of five bits). In the
lexicographic order of the permutations of ``ABCDE``, the orders in which a document goes
at a given step form intervals of Lehmer ranks: it goes at step ``k`` by filter ``f`` in
every order that starts with ``k - 1`` filters it passes and then ``f``, and the orders with
one prefix are one interval. Counts of documents per (part, mask) are added at both ends of
each interval (a difference array over ranks) and a running sum over the 120 ranks gives the
documents removed at each (order, step). Everything else follows from these sums.

Documents are counted once, per (part, mask, label), before any interval is made, so the work
after the scan is independent of the number of documents. Texts are read once; only a 32-byte
digest of each text is shuffled, for filter E.

Defined results: a null text is the empty string, a null ``lang`` is the part ``""``. Filter
E compares exact texts through their SHA-256 digests; a null doc_id is larger than every
doc_id, so a document of null doc_id fails E when a document of non-null doc_id has its text,
and rows of equal doc_id and text do not fail E through each other. A document is good (or
toxic) when any ``labels`` row of its doc_id says so; rows of a null doc_id have no label.
Repeated rows are separate documents. Every part present gets all 600 rows, zeros included;
an empty table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adpace.llm.common import table

# Fixed values of the contract: the filters in the order of their letters.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
MARKS = "[#$%&*|]"

_WORDS = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # lexicographic: rank = position


def lehmer_rank(order: str) -> int:
    """The position of a permutation of ``FILTERS`` in lexicographic order."""
    rest, rank = sorted(order), 0
    for i, x in enumerate(order):
        rank += rest.index(x) * factorial(len(order) - 1 - i)
        rest.remove(x)
    return rank


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """``(mask, step, first, stop)``: a document failing ``mask`` goes at ``step`` in ranks [first, stop).

    Bit ``i`` of a mask is filter ``FILTERS[i]``. Built by rule: every sequence of passed
    filters followed by one failed filter is a prefix, and a prefix is one interval of ranks.
    """
    found = []
    n = len(FILTERS)
    for mask in range(1 << n):
        failed = [x for i, x in enumerate(FILTERS) if mask >> i & 1]
        passed = [x for x in FILTERS if x not in failed]
        for k in range(len(passed) + 1):
            for head in permutations(passed, k):
                for f in failed:
                    prefix = "".join(head) + f
                    rest = sorted(set(FILTERS) - set(prefix))
                    first = lehmer_rank(prefix + "".join(rest))
                    found.append((mask, k + 1, first, first + factorial(n - k - 1)))
    return found


def failures(docs: DataFrame) -> DataFrame:
    """``part, doc_id, digest, mask``: filters A to D of each document (E needs all of them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    n_words = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    bits = [
        n_words < MIN_WORDS,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(DISTINCT_PERCENT) * n_words,
        F.lit(100) * upper > F.lit(UPPER_PERCENT) * F.length(text),
        text.rlike(MARKS),
    ]
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.col("doc_id"),
        F.sha2(text, 256).alias("digest"),
        mask.alias("mask"),
    )


def with_copies(failed: DataFrame) -> DataFrame:
    """Adds filter E: a smaller doc_id holds the same text. Only digests and ids are shuffled."""
    first = failed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    e = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("first_id") < F.col("doc_id")))
    return failed.join(first, "digest").select(
        "part", "doc_id", (F.col("mask") + F.when(e, 1 << 4).otherwise(0)).alias("mask")
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents per part and failed set."""
    label = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    rows = with_copies(failures(docs)).join(label, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("n_good"),
        F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("n_toxic"),
    )


def _orders(spark: SparkSession) -> DataFrame:
    rows = [(r, s + 1, o, o[s]) for r, o in enumerate(ORDERS) for s in range(len(FILTERS))]
    return spark.createDataFrame(rows, "rank int, step int, filter_order string, filter string")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of the module's contract."""
    spark = docs.sparkSession
    counts = mask_counts(docs, labels)
    intervals = spark.createDataFrame(removal_intervals(), "mask int, step int, first int, stop int")
    # The interval table has a fixed size (a few hundred rows), whatever the input.
    ends = counts.join(F.broadcast(intervals), "mask").select(
        "part", "step",
        F.array(
            F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
            F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")),
        ).alias("ends"),
        "n", "n_good", "n_toxic",
    ).select("part", "step", F.explode("ends").alias("end"), "n", "n_good", "n_toxic")
    deltas = ends.filter(F.col("end.rank") < len(ORDERS)).groupBy("part", "step", F.col("end.rank").alias("rank")).agg(
        *(F.sum(F.col(x) * F.col("end.sign")).alias(x) for x in ("n", "n_good", "n_toxic"))
    )
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = (
        totals.select("part", "total", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    )
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = grid.join(deltas, ["part", "step", "rank"], "left").select(
        "part", "total", "rank", "step",
        *(F.sum(F.coalesce(F.col(x), F.lit(0))).over(along).cast("long").alias(y)
          for x, y in (("n", "removed"), ("n_good", "good_lost"), ("n_toxic", "toxic_lost"))),
    ).join(F.broadcast(_orders(spark)), ["rank", "step"])
    per_filter = counts.select(
        "part", "mask", "n", F.explode(F.array(*(F.lit(x) for x in FILTERS))).alias("filter")
    ).groupBy("part", "filter").agg(
        F.sum(F.when(_has(F.col("mask"), F.col("filter")), F.col("n")).otherwise(0)).cast("long").alias("fails"),
        F.sum(F.when(F.col("mask") == _bit(F.col("filter")), F.col("n")).otherwise(0)).cast("long").alias("unique_fails"),
    )
    shapley = removed.groupBy("part", "filter").agg(F.sum("removed").cast("long").alias("shapley"))
    before = Window.partitionBy("part", "rank").orderBy("step")
    return (
        removed.join(per_filter, ["part", "filter"], "left")
        .join(shapley, ["part", "filter"])
        .select(
            "part", "filter_order", F.col("step").cast("int").alias("step"), "filter",
            (F.col("total") - F.sum("removed").over(before)).cast("long").alias("kept"),
            "removed",
            (F.coalesce("fails", F.lit(0)) - F.col("removed")).cast("long").alias("redundant"),
            F.coalesce("unique_fails", F.lit(0)).cast("long").alias("unique_fails"),
            "good_lost", "toxic_lost", "shapley",
        )
    )


def _bit(letter: Column) -> Column:
    bits = F.create_map(*(F.lit(v) for i, x in enumerate(FILTERS) for v in (x, 1 << i)))
    return bits[letter]


def _has(mask: Column, letter: Column) -> Column:
    return mask.bitwiseAND(_bit(letter)) != 0


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same rows in DuckDB, order by order and step, without intervals.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM d
), first AS (
  SELECT t, min(doc_id) AS m FROM d GROUP BY t
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT w.part,
    (CASE WHEN len(w.ws) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w.ws)) < 80 * len(w.ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first.m IS NOT NULL AND (w.doc_id IS NULL OR first.m < w.doc_id) THEN 16 ELSE 0 END) AS mask,
    coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic
  FROM w JOIN first ON first.t = w.t LEFT JOIN lab ON lab.doc_id = w.doc_id
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.b + b.b + c.b + d.b + e.b = 31
), steps AS (
  SELECT o, s, substr(o, s, 1) AS l FROM orders, range(1, 6) r(s)
), gone AS (
  SELECT f.part, f.mask, f.good, f.toxic, o.o,
    (SELECT min(st.s) FROM steps st JOIN letters x ON x.l = st.l WHERE st.o = o.o AND f.mask & x.b <> 0) AS at
  FROM f, orders o
), parts AS (
  SELECT DISTINCT part FROM f
), grid AS (
  SELECT p.part, st.o, st.s, st.l, x.b FROM parts p, steps st JOIN letters x ON x.l = st.l
), per_step AS (
  SELECT g.part, g.o, g.s, g.l,
    count(gn.mask) FILTER (WHERE gn.at IS NULL OR gn.at > g.s) AS kept,
    count(gn.mask) FILTER (WHERE gn.at = g.s) AS removed,
    count(gn.mask) FILTER (WHERE gn.at < g.s AND gn.mask & g.b <> 0) AS redundant,
    count(gn.mask) FILTER (WHERE gn.at = g.s AND gn.good) AS good_lost,
    count(gn.mask) FILTER (WHERE gn.at = g.s AND gn.toxic) AS toxic_lost
  FROM grid g LEFT JOIN gone gn ON gn.part = g.part AND gn.o = g.o
  GROUP BY g.part, g.o, g.s, g.l
), single AS (
  SELECT p.part, x.l, (SELECT count(*) FROM f WHERE f.part = p.part AND f.mask = x.b) AS unique_fails
  FROM parts p, letters x
), shap AS (
  SELECT part, l, sum(removed) AS shapley FROM per_step GROUP BY part, l
)
SELECT ps.part, ps.o AS filter_order, CAST(ps.s AS INTEGER) AS step, ps.l AS filter,
  CAST(ps.kept AS BIGINT) AS kept, CAST(ps.removed AS BIGINT) AS removed,
  CAST(ps.redundant AS BIGINT) AS redundant, CAST(u.unique_fails AS BIGINT) AS unique_fails,
  CAST(ps.good_lost AS BIGINT) AS good_lost, CAST(ps.toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sh.shapley AS BIGINT) AS shapley
FROM per_step ps JOIN single u ON u.part = ps.part AND u.l = ps.l
JOIN shap sh ON sh.part = ps.part AND sh.l = ps.l
"""
