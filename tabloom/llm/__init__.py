"""Operators for training-data pipelines, their queries and checks.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from tabloom.llm import (
    chat_format, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, packing, pii, quality_classifier, quality_rules,
    token_store, topk_search, whitening,
)

MODULES = (
    quality_rules, chat_format, packing, jaccard_join, line_dedup, quality_classifier, pii, mixing, topk_search, token_store,
    whitening, hard_negatives, exact_dedup,
)
QUERIES = {}
ORACLES = {}
for module in MODULES:
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
