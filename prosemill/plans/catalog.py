"""All queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from prosemill.plans import corpus, metrics, pages, records, reports, runs, streams
from prosemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "metrics", "pages", "records", "reports", "runs", "streams"]
