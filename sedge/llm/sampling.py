"""Bounded samples to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded_sample(docs: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` rows, spread over the table by a hash of the id: the same rows on every run.

    Only ids are counted and compared; texts are read for the rows that stay.
    """
    slots = 1 << 20
    n = docs.select(id_col).count()
    share = min(slots, int(slots * 0.9 * most / max(n, 1)) + 1)
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots))
    return docs.where(place < share).orderBy(place, F.col(id_col)).limit(most)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of the rows that have an id; whatever else the table holds stays behind."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
