"""Queries on the test tables; importing the sub-modules registers them."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def _load() -> None:
    from . import corpus, files, models, scores, splits, tables, text  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
