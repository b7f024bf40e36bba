"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quelora.llm import decontaminate, encode, html, langid, lines, lm, pipeline, quality, reshard, simhash, tokens


def queries() -> dict:
    return {
        "op1_tokens": tokens.op1_tokens,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_simhash": simhash.op3_simhash,
        "op4_language": langid.op4_language,
        "op5_quality": quality.op5_quality,
        "op6_lines": lines.op6_lines,
        "op7_html": html.op7_html,
        "op8_reshard": reshard.op8_reshard,
        "op9_encode": encode.op9_encode,
        "op10_lm": lm.op10_lm,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE}
