"""Queries and SQL of the training-data operators, by number."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_text, language_model, lexical_search, line_dedup, mixing, near_dedup, quality, token_align, url_filter, vector_search

MODULES = [mixing, html_text, quality, line_dedup, chat_format, url_filter, decontaminate, exact_dedup, language_model, near_dedup, lexical_search, vector_search, token_align]
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
