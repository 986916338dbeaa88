"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import chat_format, curriculum_mix, decontaminate, html_extract, language_id, lm_score, near_dup, quality_classifier, quality_rules, secret_scan

_MODULES = (quality_classifier, decontaminate, lm_score, chat_format, curriculum_mix, html_extract, language_id, quality_rules, near_dup, secret_scan)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
