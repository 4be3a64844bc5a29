"""Every registered query, section by section."""

from __future__ import annotations

from importlib import import_module

from secflow.queries.registry import Section

MODULES = ["detection", "behaviour", "scoring", "campaigns", "operations", "sources", "models", "retrieval", "streams"]


def all_sections() -> list[Section]:
    return [import_module(f"secflow.queries.{name}").section for name in MODULES]
