"""All queries outside the training-data subpackage, with their DuckDB twins."""

from __future__ import annotations

from sedge.operators import batches, cleaning, documents, files, lines, models, normalizing, paragraphs, records, reports, retrieval, sections, styles
from sedge.streaming import keyed

MODULES: tuple = (retrieval, reports, lines, cleaning, batches, documents, paragraphs, normalizing, sections, records, files, styles, models, keyed)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
