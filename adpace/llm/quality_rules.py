"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The statistics are counted per document; the forest's features are their excess
over what simple rules tolerate. Trees of random splits are grown on a
bounded sample of labelled documents; a document's mean path length gives its
anomaly score. The score's threshold comes from all labelled documents: the lowest
one that rejects at most ``MAX_GOOD_LOSS`` of those labelled good. Documents that
break a base rule are rejected without the forest.

Defined results: null text has no words, so it breaks a base rule. Without usable
labels nothing beyond the base rules is rejected. Several labels of one document
count as its lowest. Every row is judged on its own text, so repeated rows, null
ids and extra columns are no special cases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpace.llm.common import SPACE, map_columns, table
from adpace.scratch import work_dir, written

TREES = 128
SAMPLE = 256
#: The forest sees at most ``TREES * SAMPLE`` labelled documents, chosen by hash of doc_id.
MAX_FIT_ROWS = TREES * SAMPLE
MAX_GOOD_LOSS = 0.001
BINS = 10_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a rule tolerates of each ratio. The forest sees by how much a document exceeds it, so
#: documents that keep all rules lie on one dense point with long paths.
TOLERATED = {
    "symbol_ratio": 0.01, "bare_word_ratio": 0.02, "upper_ratio": 0.15, "digit_ratio": 0.2,
    "mark_ratio": 0.08, "dup_line_ratio": 0.4, "repeat_ratio": 0.35, "word_length": 1.0,
}
FEATURES = tuple(TOLERATED)
#: Usual mean word lengths; ``word_length`` is the distance from them.
WORD_LENGTHS = (3.0, 8.0)

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_MARKS = b"!?;:\"'()[]{}@/\\=+~^_"


def repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    twice = set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    total = upto = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the forest's features of one text in UTF-8."""
    words = text.split()
    n = len(words)
    n_bytes = len(text)
    n_space = n_bytes - len(text.translate(None, SPACE))
    n_code = n_bytes if text.isascii() else len(text.decode())
    chars = n_code - n_space
    count = lambda kind: n_bytes - len(text.translate(None, kind))
    n_symbols = count(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    some, letters = max(1, chars), max(1, count(_UPPER) + count(_LOWER))
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum()) if n_symbols else 0
    low, high = WORD_LENGTHS
    mean = chars / max(1, n)
    ratios = (
        n_symbols / some, bare / max(1, n), count(_UPPER) / letters, count(_DIGITS) / some, count(_MARKS) / some,
        dup_lines / max(1, len(lines)), repeats / max(1, n), max(low - mean, mean - high, 0.0),
    )
    features = tuple(max(0.0, x - most) for x, most in zip(ratios, TOLERATED.values()))
    return (n, chars, n_symbols, dup_lines, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``features``."""

    def make():
        def apply(rows):
            found = [statistics(t or b"") for t in rows["text"]]
            columns = {name: [base[i] for base, _ in found] for i, name in enumerate(BASE)}
            return columns | {
                "doc_id": rows["doc_id"],
                "base_failed": [base_failed(base[0], base[4]) for base, _ in found],
                "features": [f for _, f in found],
            }

        return apply

    counts = ", ".join(f"{name} bigint" for name in BASE)
    return map_columns(
        docs.select("doc_id", "text"), make, f"doc_id bigint, {counts}, base_failed boolean, features array<double>"
    )


def _unsuccessful(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    more = np.maximum(n, 2)
    out = 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, out))


@dataclass
class Forest:
    """Trees in arrays: a node's feature (-1: leaf), threshold, left child (right: next) and path length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: list[int]
    sample: int
    limit: float = np.inf

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1, rounded to ``BINS`` steps."""
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for root in self.roots:
            node = np.full(len(points), root)
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                right = points[rows, np.maximum(self.feature[node], 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.path[node]
        mean = total / max(1, len(self.roots))
        return np.rint(BINS * 2.0 ** (-mean / max(1e-9, float(_unsuccessful(self.sample))))) / BINS


def grow(points: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """A forest of random splits, each tree on its own part of the points."""
    rng = np.random.default_rng(seed)
    sample = max(1, min(sample, len(points)))
    limit = int(np.ceil(np.log2(max(2, sample))))
    feature, threshold, left, path, roots = [], [], [], [], []

    def add() -> int:
        for column, value in ((feature, -1), (threshold, 0.0), (left, -1), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees if len(points) else 0):
        part = points[rng.choice(len(points), sample, replace=False)]
        roots.append(add())
        open_nodes = [(roots[-1], part, 0)]
        while open_nodes:
            node, own, depth = open_nodes.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(own) < 2 or not len(wide):
                path[node] = depth + float(_unsuccessful(len(own)))
                continue
            feature[node] = f = int(rng.choice(wide))
            threshold[node] = cut = float(rng.uniform(low[f], high[f]))
            left[node] = add()
            add()
            right = own[:, f] > cut
            open_nodes += [(left[node], own[~right], depth + 1), (left[node] + 1, own[right], depth + 1)]
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(path, float), roots, sample)


def fit(stats: DataFrame, labels: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> Forest:
    """Grow the forest on a bounded labelled sample; set its limit from all labelled documents."""
    quality = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    labelled = stats.filter(~F.col("base_failed")).join(quality, "doc_id").select("doc_id", "quality", "features")
    labelled = written(labelled, work_dir(stats.sparkSession, "quality-labelled"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS).select("features")
    points = np.array([r[0] for r in chosen.collect()], dtype=float).reshape(-1, len(FEATURES))
    forest = grow(points)
    scored = map_columns(
        labelled.select("quality", "features"),
        lambda: lambda rows: {"quality": rows["quality"], "bin": _bins(forest, rows["features"])},
        "quality int, bin int",
    )
    # At most one row for each of BINS + 1 scores.
    counted = scored.groupBy("bin").agg(
        F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")
    )
    forest.limit = calibrate([tuple(r) for r in counted.collect()], max_good_loss)
    return forest


def _bins(forest: Forest, features: list) -> list[int]:
    points = np.array(features, dtype=float).reshape(-1, len(FEATURES))
    return np.rint(forest.score(points) * BINS).astype(int).tolist()


def calibrate(counted: list[tuple[int, int, int]], max_good_loss: float) -> float:
    """The lowest score bin that rejects some bad documents and at most the given share of good ones."""
    allowed = max_good_loss * sum(good for _, _, good in counted)
    limit, lost = np.inf, 0
    for at, bad, good in sorted(counted, reverse=True):
        lost += good
        if lost > allowed:
            break
        if bad:
            limit = at
    return limit


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with ``score`` and ``kept``."""

    def make():
        def apply(rows):
            bins = _bins(forest, rows["features"])
            rows["score"] = [b / BINS for b in bins]
            rows["kept"] = [not f and b < forest.limit for f, b in zip(rows["base_failed"], bins)]
            return rows

        return apply

    schema = T.StructType(
        [*stats.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )
    return map_columns(stats, make, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``score`` and ``kept``."""
    stats = written(rule_statistics(docs), work_dir(docs.sparkSession, "quality-statistics"))
    return judge(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, every column, that the rules keep. Each row is judged where it is read."""
    forest = fit(rule_statistics(docs), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [statistics(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            bins = _bins(forest, [f for _, f in found])
            kept = [not base_failed(base[0], base[4]) and b < forest.limit for (base, _), b in zip(found, bins)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *BASE, "base_failed", "kept", "score"
    )
