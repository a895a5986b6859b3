"""All registered queries and their SQL."""

from __future__ import annotations

from . import q_drafts, q_learn, q_life, q_reports, q_search, q_sources, q_text
from .registry import ORACLES, QUERIES

MODULES = (q_drafts, q_learn, q_life, q_reports, q_search, q_sources, q_text)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
