"""Registered queries."""

from tablecheck.plans.registry import REGISTRY
from tablecheck.plans import q_context, q_corpus, q_reconcile, q_profile, q_replies, q_scoring, q_sources, q_workbook

__all__ = ["REGISTRY"]
