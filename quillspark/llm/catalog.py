"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from quillspark.llm import bpe_fst, exact_dedup, language_id, line_dedup, mixing, orc_tokens, quality_model, quality_rules, simhash, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_bpe_codec": bpe_fst.op5_bpe_codec,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_orc_tokens": orc_tokens.op8_orc_tokens,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_model": quality_model.op10_quality_model,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
}
