"""The registered queries of this subpackage and the SQL they must agree with."""

from . import hard_negatives, importance, jaccard, language_model, mixing, near_vectors, page_text, pieces, suffix_dedup, token_counts, topk, toxicity, warc

MODULES = (topk, toxicity, page_text, token_counts, jaccard, pieces, mixing, warc, language_model, near_vectors, hard_negatives, suffix_dedup, importance)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
