"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import op1_lines, op10_decontam, op2_revisit, op3_repeats, op4_secrets, op5_html, op6_mixing, op7_mpeg, op8_quality, op9_minhash, oracles

QUERIES = {
    "op1_lines": op1_lines.op1_lines,
    "op2_revisit": op2_revisit.op2_revisit,
    "op3_repeats": op3_repeats.op3_repeats,
    "op4_secrets": op4_secrets.op4_secrets,
    "op5_html": op5_html.op5_html,
    "op6_mixing": op6_mixing.op6_mixing,
    "op8_quality": op8_quality.op8_quality,
    "op9_minhash": op9_minhash.op9_minhash,
    "op10_decontam": op10_decontam.op10_decontam,
    "op7_mpeg": op7_mpeg.op7_mpeg,
}
ORACLES = {
    "op2_revisit": op2_revisit.ORACLE,
    "op3_repeats": oracles.OP3,
    "op4_secrets": oracles.OP4,
    "op6_mixing": op6_mixing.ORACLE,
    "op9_minhash": oracles.OP9,
}
