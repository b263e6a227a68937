"""Collects the queries of all plan modules."""

from __future__ import annotations

from importlib import import_module

from loomspark.registry import Registry, core

MODULES = ("retrieval", "timeline", "relational", "scalars", "ingestion", "captions", "surfaces", "search", "alignment", "documents")


def load() -> Registry:
    for m in MODULES:
        import_module(f"loomspark.plans.{m}")
    return core
