"""Personal data: base patterns, and identifiers found by bootstrapped lexical contexts.

Only built-in functions. Base patterns give the seed entities. Every identifier-like word
(one with a digit or ``@``) is an instance, the words before it are its lexical patterns,
and the pattern-instance graph is scored in rounds: a pattern is as good as the mean of
its distinct instances, an unseen instance as good as its best accepted pattern. Words in
an accepted pattern that look like an identifier become spans of kind ``context``.

One pass reads the texts and keeps spans and instances only; the graph holds one edge for
each distinct pattern and instance, so a common number or phrase is one row. Scores are
whole per-mille numbers, so results do not depend on the order of sums.

Base patterns are anchored to the start of a run (or to the end of the match before) and
use possessive loops: the matches are those of the plain patterns, in linear time.

Defined results: null text has no spans. Rows with equal doc_id and text have equal spans;
ids may be null. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace.llm.common import table
from adpace.scratch import work_dir, written

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

_SMALL_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
#: Up to 32 ASCII letters or marks, a digit or ``@``, and the rest of the word. Plain ASCII classes and \\S
#: (here just what is not white space) match many times faster than negated unions.
_LIKE_ID = r"""[A-Za-z._%+'"(<\[#/-]{0,32}+[0-9@]\S*+"""
_EDGE = r"""^["'(<\[{]++|[.,;:!?"')>\]}#*$%&|]++$"""
_LEAD = r"""^["'(<\[{]++"""
_BEFORE = r"(?:\S++\s++)?\S++\s++$"

ROUNDS = 3
#: A pattern counts if it has so many distinct instances and this mean score, per mille.
MIN_INSTANCES = 5
MIN_SCORE = 800
#: An identifier found by context has so many digits.
MIN_DIGITS = 4

SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,value:string,gap:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches in order as ``start, end, value, gap`` in code points; gap: the text since the match before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))  # one gap more than values

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        new = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["gap"].alias("gap"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(new)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["value"].isNotNull()), zero, step, lambda done: done["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        digit = number.substr(n - i, F.lit(1)).cast("int")
        twice = 2 * digit
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by start, then kind; failing matches are dropped, not retried."""

    def kind(number: int, possible: Column, pattern: str, passes) -> Column:
        kept = matches(text, pattern) if passes is None else F.filter(matches(text, pattern), lambda m: passes(m["value"]))
        spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))
        return F.when(possible, spans).otherwise(F.array().cast(SPANS))

    def is_card(value: Column) -> Column:
        number = digits(value)
        return F.length(number).between(12, 19) & luhn(number)

    return F.sort_array(
        F.concat(
            kind(0, F.contains(text, F.lit("@")), EMAIL, None),
            kind(1, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), IP, lambda v: F.rlike(v, F.lit(_SMALL_PARTS))),
            kind(2, F.rlike(text, F.lit(CARD)), CARD, is_card),
            kind(3, F.rlike(text, F.lit(r"\+[0-9]")), PHONE, lambda v: F.length(digits(v)).between(9, 15)),
        )
    )


def instances(text: Column, base: Column) -> Column:
    """Identifier-like words: span, value without outer marks, the patterns before it, and whether a base span meets it."""

    def made(m: Column) -> Column:
        value = F.regexp_replace(m["value"], _EDGE, "")
        start = m["start"] + F.length(F.regexp_extract(m["value"], _LEAD, 0))
        end = start + F.length(value)
        near = F.right(m["gap"], F.lit(64))
        before = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(near, _BEFORE, 0), r"[\x20\x09-\x0D]+", " ")), "[0-9]", "0")
        two = F.lower(before)
        one = F.substring_index(two, " ", -1)
        known = F.exists(base, lambda b: (b["start"] < end) & (start < b["end"]))
        return F.struct(
            start.alias("start"), end.alias("end"), value.alias("value"),
            F.array_distinct(F.filter(F.array(two, one), lambda p: p != "")).alias("patterns"), known.alias("known"),
        )

    found = F.when(F.rlike(text, F.lit("[0-9@]")), matches(text, _LIKE_ID)).otherwise(F.array().cast(_FOUND))
    return F.filter(F.transform(found, made), lambda x: x["value"] != "")


def found_in_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, instances``: what one pass over the texts keeps."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", "text", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base"))
        .select("doc_id", "text_hash", "base", instances(F.col("text"), F.col("base")).alias("instances"))
    )


def good_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score``: the accepted patterns after the last round."""
    root = work_dir(occurrences.sparkSession, "pii-graph")
    edges = written(
        occurrences.select(F.explode("patterns").alias("pattern"), "value", "known")
        .groupBy("pattern", "value")
        .agg(F.max("known").alias("known")),
        f"{root}/edges",
    )
    seed = F.when(F.col("known"), 1000).otherwise(0).cast("bigint")
    scores = written(edges.groupBy("value").agg(F.max(seed).alias("score")), f"{root}/scores-0")
    patterns = None
    for r in range(1, rounds + 1):
        rated = edges.join(scores, "value").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
        mean = F.floor(F.col("total") / F.col("n")).cast("bigint")
        good = rated.filter((F.col("n") >= MIN_INSTANCES) & (mean >= MIN_SCORE)).select("pattern", mean.alias("pattern_score"))
        patterns = written(good, f"{root}/patterns-{r}")
        best = F.greatest(F.max(seed), F.coalesce(F.max("pattern_score"), F.lit(0)))
        if r < rounds:
            rescored = edges.join(patterns, "pattern", "left").groupBy("value").agg(best.alias("score"))
            scores = written(rescored, f"{root}/scores-{r}")
    return patterns


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: base spans and all spans of every document."""
    found = written(found_in_texts(docs), work_dir(docs.sparkSession, "pii-found"))
    occurrences = found.select("doc_id", "text_hash", F.inline("instances"))
    patterns = good_patterns(occurrences)
    unseen = occurrences.filter(~F.col("known") & (F.length(digits(F.col("value"))) >= MIN_DIGITS))
    new = (
        unseen.select("doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
        .withColumnsRenamed({"doc_id": "new_id", "text_hash": "new_hash"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_hash") == F.col("new_hash"))
    spans = F.sort_array(F.concat("base", F.coalesce("new", F.array().cast(SPANS))))
    return found.select("doc_id", "text_hash", "base").join(new, same, "left").select("doc_id", "base", spans.alias("spans"))


def op8_pii_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )

    def count(kind: int) -> Column:
        # One parameter only: a second one, even with a default, would be given the element's position.
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:4])]
    return personal_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
