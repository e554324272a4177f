"""Every query a user can run, over the supplied tables."""

from __future__ import annotations

from . import (  # noqa: F401
    browse_queries, change_queries, media_queries, reconcile_queries, store_queries, text_queries,
    value_queries,
)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
