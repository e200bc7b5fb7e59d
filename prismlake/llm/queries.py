"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, html_text, jaccard_join, language_model, mixing, quality_model, quality_rules, sharding, sstable

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_language_model": language_model.op4_language_model,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_shards": sstable.op6_token_shards,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
}
