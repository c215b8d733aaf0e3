"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import op1_bpe, op2_repeats, op3_jaccard, op4_tokens, op5_pii, op6_language, op7_rules, op8_topk, op9_packing, op10_warc, op11_resample, op12_lines, op13_lexical

QUERIES = {
    "op1_bpe": op1_bpe.query,
    "op2_repeats": op2_repeats.query,
    "op3_jaccard": op3_jaccard.query,
    "op4_token_blocks": op4_tokens.query,
    "op5_surrogates": op5_pii.query,
    "op6_language": op6_language.query,
    "op7_rule_ledger": op7_rules.query,
    "op8_topk": op8_topk.query,
    "op9_packing": op9_packing.query,
    "op10_warc_index": op10_warc.query,
    "op11_resample": op11_resample.query,
    "op12_line_dedup": op12_lines.query,
    "op13_lexical": op13_lexical.query,
}
SQL = {"op7_rule_ledger": op7_rules.SQL, "op8_topk": op8_topk.SQL, "op10_warc_index": op10_warc.SQL, "op11_resample": op11_resample.SQL, "op12_line_dedup": op12_lines.SQL, "op13_lexical": op13_lexical.SQL}
