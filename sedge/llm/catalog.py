"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sedge.llm import contamination, exact_dedup, language, licenses, packing, periodic, pieces, privacy, quality, repair, similar, topk, toxicity


def queries() -> dict:
    return {
        "op1_licenses": licenses.query,
        "op2_language": language.query,
        "op3_sentencepiece": pieces.query,
        "op4_personal_data": privacy.query,
        "op5_quality": quality.query,
        "op6_packing": packing.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_similar": similar.query,
        "op9_toxicity": toxicity.query,
        "op10_topk": topk.query,
        "op11_repair": repair.query,
        "op12_periodic": periodic.query,
        "op13_contamination": contamination.query,
    }


def oracle_sql() -> dict:
    return {"op7_exact_dedup": exact_dedup.SQL, "op8_similar": similar.SQL, "op10_topk": topk.SQL, "op11_repair": repair.SQL, "op13_contamination": contamination.SQL}
