"""The queries of this subpackage and their SQL."""

from . import chat_format, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, token_counts

_MODULES = [mixing, token_counts, exact_dedup, quality_classifier, jaccard_join, language_id, chat_format, quality_rules, packing, lm_scoring]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: x for m in _MODULES for k, x in m.SQL.items()}
