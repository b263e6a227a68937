"""Queries of the numbered operators."""

from __future__ import annotations

from importlib import import_module

from loomspark.registry import Registry

llm = Registry()

_QUERIES = (
    "q_chat",
    "q_language",
    "q_licenses",
    "q_mixing",
    "q_mpegts",
    "q_neardup",
    "q_neighbours",
    "q_packing",
    "q_passages",
    "q_secrets",
    "q_toxicity",
    "q_trie",
    "q_vectors",
)

for _m in _QUERIES:
    import_module(f"loomspark.llm.{_m}").register(llm)
