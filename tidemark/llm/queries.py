"""The queries of the text operators and the SQL that some of them have."""

from __future__ import annotations

from . import decontaminate, extract, langid, line_dedup, lm_score, mixing, near_dedup, passages, pii, topk


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_decontaminate": decontaminate.query,
        "op3_passages": passages.query,
        "op4_extract": extract.query,
        "op5_langid": langid.query,
        "op6_mixing": mixing.query,
        "op7_topk": topk.query,
        "op8_lm_score": lm_score.query,
        "op9_line_dedup": line_dedup.query,
        "op10_near_dedup": near_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.SQL,
        "op2_decontaminate": decontaminate.SQL,
        "op6_mixing": mixing.SQL,
        "op7_topk": topk.SQL,
        "op9_line_dedup": line_dedup.SQL,
    }
