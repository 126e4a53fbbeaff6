"""Registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("text_plans", "row_plans", "join_plans", "metric_plans", "split_plans", "collate_plans", "frame_plans", "decision_plans", "event_plans", "source_plans")


def books():
    return [importlib.import_module(f"{__name__}.{f}").BOOK for f in FAMILIES]


def queries() -> dict:
    return {name: q for b in books() for name, q in b.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for b in books() for name, sql in b.oracles.items()}
