"""All queries of this package by name."""

from . import chat, cotraining, extraction, filter_audit, jaccard, merkle, packing, repetition, secret_scan, token_spans, toxicity, warc, winnowing

MODULES = (cotraining, warc, repetition, toxicity, winnowing, packing, secret_scan, token_spans, jaccard, extraction,
           chat, filter_audit, merkle)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
