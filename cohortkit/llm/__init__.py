"""Operators for preparing training text; nothing else in the library imports them."""


def load_all() -> tuple[dict, dict]:
    """Import every operator module; returns its queries and SQL by name."""
    from cohortkit.llm import (chat_format, compact_windows, decontamination, fingerprints, license_scan, line_dedup, mixing, ngram_join,  # noqa: F401
                               periodic_runs, quality_rules, source_divergence, substring_index, token_counts)
    from cohortkit.llm.registry import QUERIES, SQL

    return QUERIES, SQL
