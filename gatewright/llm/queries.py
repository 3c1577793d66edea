"""The queries of this subpackage and their SQL."""

from gatewright.llm import best_fit, chat_format, cross_polytope, exact_whitening, language_fusion, line_templates, pii, positional_index, prefix_trie, substring_countmin, toxicity_ftrl, warc_zip
from gatewright.llm.simhash_golay import op10_simhash_golay

QUERIES = {
    "op1_best_fit": best_fit.op1_best_fit,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_toxicity_ftrl": toxicity_ftrl.op3_toxicity_ftrl,
    "op4_line_templates": line_templates.op4_line_templates,
    "op5_positional_index": positional_index.op5_positional_index,
    "op6_language_fusion": language_fusion.op6_language_fusion,
    "op7_cross_polytope": cross_polytope.op7_cross_polytope,
    "op8_pii": pii.op8_pii,
    "op9_substring_countmin": substring_countmin.op9_substring_countmin,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_exact_whitening": exact_whitening.op13_exact_whitening,
}

ORACLES: dict[str, str] = {
    "op2_warc_zip": warc_zip.ORACLE_SQL,
    "op5_positional_index": positional_index.ORACLE_SQL,
    "op9_substring_countmin": substring_countmin.ORACLE_SQL,
    "op11_chat_format": chat_format.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
