"""Operators for preparing training text, and the queries that apply them to the given tables."""

from __future__ import annotations

import importlib

from .registry import CHECKS, QUERIES

GROUPS = (
    "substring_dedup", "decontamination", "token_counts", "toxicity", "language_id", "context_mixing", "mixing", "license_scan", "jaccard_join", "vector_graph", "credential_links", "lexical_search", "token_alignment",

)


def load() -> tuple[dict, dict]:
    """Import every group; each registers its query where it is defined."""
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
    return QUERIES, CHECKS
