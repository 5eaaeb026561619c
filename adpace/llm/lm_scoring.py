"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

The probability of a token given its history is ``P(class | history) * P(token | class)``.
Classes are the low bits of a 64-bit hash of the token (``CLASSES`` of them). The class
softmax is a maximum-entropy model over hashed features of the history: the previous token,
the previous two tokens, and the token two back (a skip bigram), each hashed to one of
``ROWS`` rows of ``CLASSES`` weights, plus a bias per class. Inside a class, a token's
probability is its smoothed count among the class's training tokens (the maximum-entropy
model with only a bias per token, whose optimum has this closed form), with one unseen slot
per class, smoothed as the base model is.

Training is distributed: in each of ``EPOCHS`` rounds every task starts from the broadcast
weights, runs AdaGrad over mini-batches of its own training tokens in NumPy, and returns its
change weighted by its number of tokens; Spark sums the changes (``Summarizer`` over chunks of
the weight vector) and the driver averages them (iterative parameter mixing). The weights
have a fixed size (``ROWS x CLASSES`` floats) whatever the corpus; what grows with the corpus,
the token counts, stays in Spark. The scoring tasks compute the class part in sparse NumPy
batches (row gathers of hashed features) and look up the counts of the ``FREQUENT`` most
frequent training tokens, which hold most occurrences; the hash of every other token leaves
the task and meets its count by a join. Training tasks are coalesced to one per ``TOKENS_PER_TASK`` training tokens, so the
changes they hand in stay a small part of the input.

Defined results: a null text is empty and has one token (the end). Tokens are words of
lower-cased A-Z, then the end, which no word can equal (it is a line break). A null doc_id
is held out: not learned from, and ``held_out`` true. Repeated rows are scored each and
learned from each. ``score`` and ``base_score`` are log10 probabilities; an empty training
set gives every token the unseen slot. Only doc_id and text are read. Tokens are told apart
by their 64-bit hash: two that share one would be counted as one, with probability about
2**-64 per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace.llm.common import table
from adpace.scratch import discarded, work_dir, written

# Fixed values of the contract.
HELD_OUT_EVERY = 10
SMOOTHING = 0.1
END = "\n"
_SPACE = r"[\x20\x09-\x0D]+"

#: Classes of the factored softmax (a power of two: classes are the low bits of a hash).
CLASSES = 32
#: Rows of hashed feature weights (a power of two); the model has ROWS x CLASSES + CLASSES floats.
ROWS = 1 << 16
EPOCHS = 1
LEARNING_RATE = 0.2
BATCH_TOKENS = 8192
#: Floats per chunk in which tasks hand their changes to the sum.
CHUNK = 1 << 16
#: Training tokens per training task: each task hands in one change of the whole model.
TOKENS_PER_TASK = 1 << 24
#: The most frequent training tokens, whose counts every scoring task holds (a bound on what
#: is broadcast); the counts of all other tokens meet their documents by a join.
FREQUENT = 1 << 16

_START = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: Column) -> Column:
    """Words of the text with A-Z lower-cased, then the end."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, _SPACE), lambda w: w != "")
    return F.concat(words, F.array(F.lit(END)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_EVERY == 0, F.lit(True))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (n x 3: previous, previous two, two back) and class of each token.

    ``hashes`` are the tokens' 64-bit hashes of a batch of documents laid end to end, and
    ``starts`` marks each token that begins a document.
    """
    h = hashes.view(np.uint64)
    n = len(h)
    position = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    prev1 = np.where(position >= 1, np.roll(h, 1), _START)
    prev2 = np.where(position >= 2, np.roll(h, 2), _START)
    with np.errstate(over="ignore"):
        rows = np.stack(
            [
                _mix(prev1 ^ np.uint64(1)),
                _mix(prev1 * np.uint64(0x100000001B3) ^ prev2 ^ np.uint64(2)),
                _mix(prev2 ^ np.uint64(3)),
            ],
            axis=1,
        ) & np.uint64(ROWS - 1)
    return rows.astype(np.int64), (h % np.uint64(CLASSES)).astype(np.int64)


def class_logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all classes for each token, less their largest, and the log of their normaliser."""
    logits = np.take(weights, rows[:, 0], axis=0)
    logits += bias
    logits += np.take(weights, rows[:, 1], axis=0)
    logits += np.take(weights, rows[:, 2], axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    return logits, np.log(np.exp(logits).sum(axis=1))


def class_log_probs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) of each token."""
    logits, log_z = class_logits(weights, bias, rows)
    return logits[np.arange(len(classes)), classes] - log_z


def _batch_tokens(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.zeros(len(hashes), dtype=bool)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return hashes, starts, offsets


def _pieces(n: int, size: int) -> Iterator[slice]:
    for a in range(0, n, size):
        yield slice(a, min(a + size, n))


def _piece_features(hashes: np.ndarray, starts: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of one slice of a batch, which needs the two tokens before it as context."""
    lo = max(part.start - 2, 0)
    rows, classes = features(hashes[lo : part.stop], starts[lo : part.stop])
    return rows[part.start - lo :], classes[part.start - lo :]


def fit_changes(docs: DataFrame, params: np.ndarray) -> np.ndarray:
    """One round of parameter mixing: the token-weighted sum of every task's change, and the tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(params)
    size = len(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        # Trained in single precision, which halves the memory traffic of every step.
        weights = start[: ROWS * CLASSES].reshape(ROWS, CLASSES).astype(np.float32)
        bias = start[ROWS * CLASSES :].astype(np.float32)
        g_weights = np.full_like(weights, 1e-6)
        g_bias = np.full_like(bias, 1e-6)
        seen = 0
        for batch in batches:
            hashes, starts, _ = _batch_tokens(batch, "hashes")
            for part in _pieces(len(hashes), BATCH_TOKENS):
                r, c = _piece_features(hashes, starts, part)
                logits, log_z = class_logits(weights, bias, r)
                logits -= log_z[:, None]
                grad = np.exp(logits, out=logits)
                grad[np.arange(len(c)), c] -= 1.0
                # Sum the gradient per touched row: sort the rows once and add runs; the
                # k-th feature row belongs to token k // 3.
                flat_rows = r.ravel()
                order = np.argsort(flat_rows)
                ordered = flat_rows[order]
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                touched = ordered[first]
                sums = np.add.reduceat(np.take(grad, order // 3, axis=0), first, axis=0)
                g = np.take(g_weights, touched, axis=0)
                g += sums * sums
                g_weights[touched] = g
                sums *= LEARNING_RATE
                sums /= np.sqrt(g, out=g)
                weights[touched] = np.take(weights, touched, axis=0) - sums
                b = grad.sum(axis=0)
                g_bias += b * b
                bias -= LEARNING_RATE * b / np.sqrt(g_bias)
            seen += len(hashes)
        change = (np.concatenate([weights.ravel(), bias]).astype(np.float64) - start) * seen
        change = np.append(change, float(seen))
        for k, part in enumerate(_pieces(len(change), CHUNK)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([change[part].astype(np.float32)], pa.list_(pa.float32()))],
                names=["chunk", "values"],
            )

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    summed = (
        docs.select("hashes")
        .mapInArrow(run, "chunk int, values array<float>")
        .groupBy("chunk")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))
        .toArrow()
    )
    shared.unpersist()
    total = np.zeros(size + 1)
    for k, values in zip(summed.column("chunk").to_pylist(), summed.column("values").to_numpy(zero_copy_only=False)):
        total[k * CHUNK : k * CHUNK + len(values)] = values
    return total


@dataclass
class Model:
    """What was learned: the class softmax's weights and the counts behind the base model."""

    params: np.ndarray
    counts: DataFrame  # hash, count: every training token
    classes: np.ndarray  # per class: tokens, distinct tokens
    train_tokens: int
    distinct: int
    frequent: tuple[np.ndarray, np.ndarray]  # hashes (sorted) and counts of the most frequent tokens

    @property
    def weights(self) -> np.ndarray:
        return self.params[: ROWS * CLASSES].reshape(ROWS, CLASSES)

    @property
    def bias(self) -> np.ndarray:
        return self.params[ROWS * CLASSES :]


def tokenised(docs: DataFrame) -> DataFrame:
    """``kid, kh, doc_id, held_out, hashes``, the 64-bit hash of each token in order.

    ``(kid, kh)`` is doc_id and a 64-bit hash of doc_id and text: equal for equal rows, and
    for rows of one doc_id whose texts differ only with probability 2**-64.
    """
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("kid"),
        F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("kh"),
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
    )


def token_class(token_hash: Column) -> Column:
    return F.pmod(token_hash, F.lit(CLASSES)).cast("int")


def fit(docs: DataFrame, epochs: int = EPOCHS) -> Model:
    """Counts of all training tokens, and the class softmax trained on all of them."""
    return fit_tokens(tokenised(docs), epochs)


def fit_tokens(rows: DataFrame, epochs: int = EPOCHS) -> Model:
    """``fit`` of the rows of ``tokenised``."""
    spark = rows.sparkSession
    train = rows.filter(~F.col("held_out"))
    counts = written(
        train.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("count")),
        work_dir(spark, "token-counts"),
    )
    classes = np.zeros((CLASSES, 2), dtype=np.int64)
    for r in counts.groupBy(token_class(F.col("hash")).alias("class")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        classes[r["class"]] = (r["n"], r["v"])
    n = int(classes[:, 0].sum())
    top = counts.orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()
    hashes = np.array([r["hash"] for r in top], dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    frequent = (hashes[order], np.array([r["count"] for r in top], dtype=np.int64)[order])
    tasks = max(1, math.ceil(n / TOKENS_PER_TASK))
    hashed = train.select("hashes").coalesce(tasks)
    params = np.zeros(ROWS * CLASSES + CLASSES)
    for _ in range(epochs):
        total = fit_changes(hashed, params)
        if total[-1] > 0:
            params = params + total[:-1] / total[-1]
    return Model(
        params=params.astype(np.float32),
        counts=counts,
        classes=classes,
        train_tokens=n,
        distinct=int(classes[:, 1].sum()),
        frequent=frequent,
    )


def _log10_smoothed(c: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.log10((c + SMOOTHING) / (n + SMOOTHING * (v + 1)))


def class_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: tokens, the class part in log10, the parts of the frequent tokens, and the others' hashes.

    ``kid, kh, doc_id, held_out, n_tokens, class_score, known_f, base_f, word_f, rare``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.params, model.frequent, model.classes))
    ln10 = math.log(10)
    n, v = model.train_tokens, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, (f_hash, f_count), classes = shared.value
        weights, bias = params[: ROWS * CLASSES].reshape(ROWS, CLASSES), params[ROWS * CLASSES :]
        for batch in batches:
            hashes, starts, offsets = _batch_tokens(batch, "hashes")
            logs, base, word = (np.zeros(len(hashes)) for _ in range(3))
            known = np.zeros(len(hashes), dtype=bool)
            for part in _pieces(len(hashes), BATCH_TOKENS):
                rows, cls = _piece_features(hashes, starts, part)
                logs[part] = class_log_probs(weights, bias, rows, cls)
                if not len(f_hash):
                    continue
                h = hashes[part]
                at = np.minimum(np.searchsorted(f_hash, h), len(f_hash) - 1)
                hit = f_hash[at] == h
                c = np.where(hit, f_count[at], 0).astype(np.float64)
                known[part] = hit
                base[part] = np.where(hit, _log10_smoothed(c, n, v), 0.0)
                word[part] = np.where(hit, _log10_smoothed(c, classes[cls, 0], classes[cls, 1]), 0.0)
            starts_at, empty = offsets[:-1], np.diff(offsets) == 0
            rare_at = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)

            def per_row(x):
                out = np.add.reduceat(x, starts_at) if len(x) else np.zeros(len(starts_at))
                out[empty] = 0
                return out

            yield pa.RecordBatch.from_arrays(
                [batch.column("kid"), batch.column("kh"), batch.column("doc_id"), batch.column("held_out"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(per_row(logs) / ln10),
                 pa.array(per_row(known.astype(np.int64))), pa.array(per_row(base)), pa.array(per_row(word)),
                 pa.ListArray.from_arrays(pa.array(rare_at), pa.array(hashes[~known]))],
                names=["kid", "kh", "doc_id", "held_out", "n_tokens", "class_score", "known_f", "base_f", "word_f", "rare"],
            )

    return docs.select("kid", "kh", "doc_id", "held_out", "hashes").mapInArrow(
        run,
        "kid bigint, kh bigint, doc_id bigint, held_out boolean, n_tokens bigint, class_score double, "
        "known_f bigint, base_f double, word_f double, rare array<bigint>",
    )


def rare_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``kid, kh, known_r, base_r, word_r``: the parts of the tokens that are not among the frequent.

    ``rows`` are those of ``class_scores``. The counts meet documents by a join on the token's
    hash. Rows of one key are copies, so each key's sums are divided by its number of rows.
    """
    spark = rows.sparkSession
    n, v = model.train_tokens, model.distinct
    stats = spark.createDataFrame(
        [(k, int(a), int(b)) for k, (a, b) in enumerate(model.classes)], "class int, n bigint, v bigint"
    )
    pairs = (
        rows.select("kid", "kh", F.explode("rare").alias("hash"))
        .groupBy("kid", "kh", "hash")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    c = F.coalesce(F.col("count"), F.lit(0)).cast("double")
    # The broadcast has CLASSES rows, which do not grow with the corpus.
    known = pairs.join(model.counts, "hash", "left").select(
        "kid", "kh", "times", c.alias("c"), token_class(F.col("hash")).alias("class")
    ).join(F.broadcast(stats), "class")
    base = F.log10((F.col("c") + SMOOTHING) / F.lit(n + SMOOTHING * (v + 1)))
    word = F.log10((F.col("c") + SMOOTHING) / (F.col("n") + SMOOTHING * (F.col("v") + 1)))
    sums = known.groupBy("kid", "kh").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * base).alias("base"),
        F.sum(F.col("times") * word).alias("word"),
    )
    copies = rows.groupBy("kid", "kh").agg(F.count(F.lit(1)).alias("copies"))
    return sums.join(copies, ["kid", "kh"]).select(
        "kid", "kh",
        (F.col("known") / F.col("copies")).cast("long").alias("known_r"),
        (F.col("base") / F.col("copies")).alias("base_r"),
        (F.col("word") / F.col("copies")).alias("word_r"),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document: its tokens, how many are known, the base and the model's log10 probability."""
    return score_tokens(tokenised(docs), model)


def score_tokens(rows: DataFrame, model: Model) -> DataFrame:
    """``score`` of the rows of ``tokenised``. The class scores are stored: two steps read them."""
    scored = written(class_scores(rows, model), work_dir(rows.sparkSession, "class-scores"))
    zero = F.lit(0)
    return (
        scored
        .join(rare_scores(scored, model), ["kid", "kh"], "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("known_f") + F.coalesce("known_r", zero)).cast("long").alias("n_known"),
            F.lit(model.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base_f") + F.coalesce("base_r", zero)).alias("base_score"),
            (F.col("class_score") + F.col("word_f") + F.coalesce("word_r", zero)).alias("score"),
        )
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Texts become hashes once: counting, training and scoring read them.
    path = work_dir(spark, "token-hashes")
    rows = written(tokenised(docs), path)
    scores = score_tokens(rows, fit_tokens(rows))
    discarded(spark, path)  # the stored class scores are all that is read from here on
    return scores
