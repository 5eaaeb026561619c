"""Language ID: one Bloom filter per language, bit-sliced into language masks.

Character n-grams of learned documents enter the filter of each language in which they
are common. All filters share one table: a slot holds the mask of the languages that set
it, so the masks of an n-gram's slots, and-ed, give every language that contains it.
A language's popcount over a text, less the hits that its filter's fill predicts for
absent n-grams, is its evidence; the largest wins.

The model is fitted on a bounded sample: at most ``DOCS_PER_LANGUAGE`` documents of each
language, by hash of doc_id. A mask has one word for each
32 languages, so any number of languages is told apart.

Defined results: ``und`` with score 0 if text is null or has no letter (numbers of any kind,
such as ``½``, ``²``, ``Ⅷ`` or ``٣``, are no letters), or nothing was
learned. Ties go to the first language by name. Held-out documents are never learned
from, and a prediction reads the text alone. A null doc_id is neither learned from nor
held out. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adpace.llm.common import map_columns, table
from adpace.scratch import work_dir, written

ORDERS = (2, 3, 4)
DOCS_PER_LANGUAGE = 500
GRAMS_PER_LANGUAGE = 6000
#: Parts of a language that are cut to the sample's size before they meet in one task.
SLICES = 64
#: A language contains an n-gram if its share there is at least this part of the highest share anywhere.
MIN_OF_HIGHEST = 0.4
#: Languages in a word of a mask.
WORD = 32
SLOTS = 1 << 17
HASHES = 3
#: Code points that are looked up at a time.
CHUNK = 1 << 18

_NO_LETTER = re.compile(r"[\W\d_]+")
#: Numeric characters that are not decimal digits (such as fractions, superscripts, Roman
#: numerals) count as word characters for ``re``; they are no letters and become spaces.
_NUMERIC = {c: " " for c in range(0x110000) if chr(c).isnumeric()}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str) -> str:
    """Lower case; everything but letters becomes one space; a space at both ends."""
    return f" {_NO_LETTER.sub(' ', text.lower().translate(_NUMERIC)).strip()} "


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of a normalised text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out, key = [], points + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        key = key[:-1] * _ODD + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            out.append(mixed(key + np.uint64(n)))
    return np.concatenate(out)


def slots(keys: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(SLOTS - 1)
    return [((keys >> np.uint64(20 * i)) & bits).astype(np.int64) for i in range(HASHES)]


def bit(language: int) -> np.uint32:
    """The bit of a language in its word."""
    return np.uint32(1 << language % WORD)


@dataclass
class Model:
    languages: list[str]
    #: One row for each word, one column for each slot.
    masks: np.ndarray
    #: The share of absent n-grams that each filter claims to hold.
    false_share: np.ndarray
    #: The share of n-grams of the language's own documents that its filter holds.
    own_share: np.ndarray

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram, one row for each word."""
        out = np.full((len(self.masks), len(keys)), 0xFFFFFFFF, dtype=np.uint32)
        for at in slots(keys):
            for word, mask in zip(out, self.masks):
                word &= mask[at]
        return out

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams of a normalised text by language, and all of them."""
        total, seen = np.zeros(len(self.languages)), 0
        overlap = max(ORDERS) - 1
        for at in range(0, max(1, len(text) - overlap), CHUNK):
            mask = self.languages_of(grams(text[at : at + CHUNK + overlap]))
            seen += mask.shape[1]
            total += [np.count_nonzero(mask[i // WORD] & bit(i)) for i in range(len(self.languages))]
        return total, seen

    def predict(self, text: str | None) -> tuple[str, float]:
        clean = normal(text or "")
        if not clean.strip() or not self.languages:
            return "und", 0.0
        found, seen = self.counts(clean)
        share = np.clip((found / max(1, seen) - self.false_share) / np.maximum(1e-9, 1 - self.false_share), 0, 1)
        share = np.minimum(share / np.maximum(1e-9, self.own_share), 1.0)
        best = int(share.argmax())
        total = share.sum()
        return self.languages[best], float(share[best] / total) if total else 0.0


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Count n-grams of the sample in Spark; the driver gets the most common of each language."""
    known = docs.filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # Choose by id first: only the sample's texts travel. The last task of a language gets
    # at most SLICES * docs_per_language ids, however many tasks read the documents.
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.select("doc_id", "lang", F.pmod(order[0], F.lit(SLICES)).alias("slice"))
    chosen = ids
    for group in (("lang", "slice"), ("lang",)):
        at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        chosen = chosen.withColumn("at", at).filter(F.col("at") <= docs_per_language)
    chosen = F.broadcast(chosen.select("doc_id").distinct())  # at most docs_per_language rows a language
    sample = known.join(chosen, "doc_id", "left_semi").select("lang", "text")

    def make():
        def apply(rows):
            langs, keys, counts = [], [], []
            for lang, text in zip(rows["lang"], rows["text"]):
                clean = normal(text.decode())
                if clean.strip():
                    key, count = np.unique(grams(clean), return_counts=True)
                    langs += [lang.decode()] * len(key)
                    keys.append(key.view(np.int64))
                    counts.append(count)
            if not langs:
                return {"lang": [], "gram": [], "seen": []}
            return {"lang": langs, "gram": np.concatenate(keys), "seen": np.concatenate(counts).astype(np.int64)}

        return apply

    counted = map_columns(sample, make, "lang string, gram bigint, seen bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("seen").alias("seen"))
    totals = written(totals, work_dir(docs.sparkSession, "language-grams"))
    common = Window.partitionBy("lang").orderBy(F.desc("seen"), "gram")
    top = totals.withColumn("at", F.row_number().over(common)).filter(F.col("at") <= GRAMS_PER_LANGUAGE)
    sums = {r["lang"]: r["n"] for r in totals.groupBy("lang").agg(F.sum("seen").alias("n")).collect()}
    languages = sorted(sums)
    share_of: dict[str, dict[int, float]] = {x: {} for x in languages}
    for r in top.select("lang", "gram", "seen").collect():
        share_of[r["lang"]][r["gram"]] = r["seen"] / sums[r["lang"]]
    highest: dict[int, float] = {}
    for shares in share_of.values():
        for gram, share in shares.items():
            highest[gram] = max(share, highest.get(gram, 0.0))
    masks = np.zeros((-(-len(languages) // WORD), SLOTS), dtype=np.uint32)
    own = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        typical = [g for g, share in share_of[lang].items() if share >= MIN_OF_HIGHEST * highest[g]]
        own[i] = sum(share_of[lang][g] for g in typical)
        for at in slots(np.array(typical, dtype=np.int64).view(np.uint64)):
            masks[i // WORD][at] |= bit(i)
    fill = np.array([np.count_nonzero(masks[i // WORD] & bit(i)) / SLOTS for i in range(len(languages))])
    return Model(languages, masks, fill**HASHES, own)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""

    def make():
        def apply(rows):
            found = [model.predict(t.decode() if t else None) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"], "held_out": rows["held_out"],
                "lang_pred": [x for x, _ in found], "score": [s for _, s in found],
            }

        return apply

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_columns(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
