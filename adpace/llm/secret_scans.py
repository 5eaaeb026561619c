"""Secret scans: base patterns, and assignment-aware lexing of source and configuration syntax.

Lines with ``=`` or ``:`` are lexed into name-literal pairs. A name bound to an
earlier name takes over that name's literal (constant propagation), so a literal
counts under every name that it reaches. A pair's score is the sensitivity of its
name times the strength of its literal; literals at the threshold become spans of
kind ``literal`` unless a base span covers them. White space weakens a literal, unless
its name is strong.

Defined results: null text is empty; every row is scanned whole and on its own, so
repeated rows, null ids and extra columns are no special cases.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpace.llm.common import map_columns, table

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 0.6
MASK = "[SECRET]"
#: From this name score on, a literal of several words is as strong as one word.
STRONG_NAME = 0.9

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

# A name, an optional type in the manner of `name: str = value`, and a literal or another name.
_PAIR = re.compile(
    r"""(?:^|(?<=[\s,;{(\[]))["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?::[\x20\t]*+[A-Za-z_]\w*+[\x20\t]*+=|:=|=>|[:=])[\x20\t]*+"""
    r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([^\s"',;(){}\[\]]++))""",
    re.ASCII | re.MULTILINE,
)
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.\w+)*", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How strongly a part of a name marks its value as secret, and parts that tell of something else.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.7, "auth": 0.7, "bearer": 0.9,
    "signing": 0.7, "encryption": 0.7, "access": 0.5, "api": 0.5, "key": 0.5, "salt": 0.6, "pin": 0.6,
}
HARMLESS = {
    "id", "name", "length", "len", "count", "size", "max", "min", "type", "path", "file", "url", "ttl", "timeout",
    "expires", "expiry", "policy", "field", "label", "header", "public", "limit", "index", "format",
}


def name_score(name: str) -> float:
    """0 to 1: sensitive parts add up by noisy or; a harmless part halves the score."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    left = 1.0
    for part in parts:
        left *= 1 - SENSITIVE.get(part, 0.0)
    score = 1 - left
    return score / 2 if HARMLESS.intersection(parts) else score


def literal_score(value: str, name: float) -> float:
    """0 to 1: entropy over the whole literal, with its mix of letters and digits; ``name``: its name's score.

    The entropy is not capped before the mix is weighed, so long literals of letters alone can be strong.
    """
    if len(value) < 6 or value.isspace() or len(set(value)) < 4:
        return 0.0
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    score = min(1.0, entropy / 3.0 * (1.0 if mixed else 0.6 if value.isalpha() else 0.8))
    return score / 2 if " " in value and name < STRONG_NAME else score


def name_literals(text: str) -> list[tuple[str, int, int]]:
    """``name, start, end`` for every name that a literal reaches, by order of assignment."""
    bound: dict[str, tuple[int, int]] = {}
    pairs = []
    for m in _PAIR.finditer(text):
        name, bare = m[1], m[4]
        if bare is not None and _NAME.fullmatch(bare) and bare in bound:
            span = bound[bare]
        else:
            span = m.span(m.lastindex)
        bound[name] = span
        pairs.append((name, *span))
    return pairs


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base patterns, sorted; failing matches are dropped, not retried."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def literal_spans(text: str, base: list[tuple[int, int, int]], min_score: float) -> list[tuple[int, int, int]]:
    """Further literals whose best pair reaches ``min_score``, apart from what base spans cover."""
    if "=" not in text and ":" not in text:
        return []
    best: dict[tuple[int, int], float] = {}
    for name, start, end in name_literals(text):
        score = name_score(name)
        if score > best.get((start, end), 0.0):
            best[start, end] = score
    covered = [(s, e) for s, _, e in base]
    return [
        (start, 3, end)
        for (start, end), score in sorted(best.items())
        if score >= min_score
        and score * literal_score(text[start:end], score) >= min_score
        and not any(s <= start and end <= e for s, e in covered)
    ]


def scan(text: str, min_score: float = MIN_SCORE) -> tuple[list, list]:
    """Base spans and all spans of a text, as ``start, kind, end``."""
    base = base_spans(text)
    return base, sorted(base + literal_spans(text, base, min_score))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, base, spans``: code-point spans in order of start, then kind."""

    def make():
        def as_rows(spans):
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def apply(rows):
            found = [scan(t.decode() if t else "", min_score) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "base": [as_rows(b) for b, _ in found],
                "spans": [as_rows(a) for _, a in found],
            }

        return apply

    return map_columns(docs.select("doc_id", "text"), make, f"doc_id bigint, base {SPANS}, spans {SPANS}")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by ``MASK``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, every column, with secrets in ``text`` masked; no row is dropped."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := scan(text, min_score)[1]):
                    texts[i] = mask(text, spans)
            columns = batch.columns
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(column: str):
        return F.array_join(
            F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
            ",",
        )

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
