"""Queries by name and their SQL, gathered from the plan modules."""

from __future__ import annotations

from docweave.plans import analysis, behavior, compliance, corpus, decisions, elements, factors, fusion, graphs, hybrid, kernels, layout, matrix, numeric, order, paths, recurrence, retrieval, routing, sources, space, spatial, streams, tables, text, topology  # noqa: F401
from docweave.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
