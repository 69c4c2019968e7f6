"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from claimspark.llm import alignment, ann, exact_dedup, hmm, line_dedup, main_text, mixing, packing, phrases, simhash, token_files, toxicity, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_hmm": hmm.op3_hmm,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_ann": ann.op6_ann,
    "op7_packing": packing.op7_packing,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_main_text": main_text.op11_main_text,
    "op12_phrases": phrases.op12_phrases,
    "op13_alignment": alignment.op13_alignment,
}
MODULES = (alignment, ann, exact_dedup, hmm, line_dedup, main_text, mixing, packing, phrases, simhash, token_files, toxicity, url_filter)
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
