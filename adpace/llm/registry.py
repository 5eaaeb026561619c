"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from adpace.llm import block_search, filter_audit, hard_negatives, jaccard_join, line_dedup
from adpace.llm.block_search import op6_block_search
from adpace.llm.chat_format import op1_chat_format
from adpace.llm.filter_audit import op12_filter_audit
from adpace.llm.hard_negatives import op11_hard_negatives
from adpace.llm.jaccard_join import op9_jaccard_join, op9_jaccard_links
from adpace.llm.language_id import op10_language_id
from adpace.llm.line_dedup import op3_line_dedup
from adpace.llm.lm_scoring import op13_lm_scoring
from adpace.llm.packing import op5_packing
from adpace.llm.piece_codec import op7_sentencepiece_codec
from adpace.llm.pii_context import op8_pii_context
from adpace.llm.quality_rules import op2_quality_rules
from adpace.llm.secret_scans import op4_secret_scans

QUERIES = (
    op1_chat_format, op2_quality_rules, op3_line_dedup, op4_secret_scans, op5_packing,
    op6_block_search, op7_sentencepiece_codec, op8_pii_context, op9_jaccard_join, op9_jaccard_links,
    op10_language_id, op11_hard_negatives, op12_filter_audit, op13_lm_scoring,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def statements() -> dict[str, str]:
    found = {
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op6_block_search": block_search.ORACLE_SQL,
        "op9_jaccard_join": jaccard_join.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
    }
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
