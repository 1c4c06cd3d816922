"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import JOBS, SQL, Job

MODULES = ("cleaning", "summaries", "anonymisation", "fidelity", "synthesis", "utility")


def _load() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")


def jobs() -> dict[str, Job]:
    _load()
    return dict(JOBS)


def sql() -> dict[str, str]:
    _load()
    return dict(SQL)
