"""The queries of this subpackage, with SQL where SQL can express them."""

from . import bpe, chat, collocations, decontamination, html_text, pii, quality_rules, sharding, simhash, site_quality, suffix_dedup, toxicity, whitening

_OPERATORS = {
    "op1_chat_formatting": (chat.op1_chat_formatting, chat.OP1_SQL),
    "op2_toxicity": (toxicity.op2_toxicity, None),
    "op3_decontamination": (decontamination.op3_decontamination, None),
    "op4_histogram_sharding": (sharding.op4_histogram_sharding, None),
    "op5_html_text": (html_text.op5_html_text, None),
    "op6_byte_bpe": (bpe.op6_byte_bpe, None),
    "op7_simhash": (simhash.op7_simhash, None),
    "op8_site_quality": (site_quality.op8_site_quality, None),
    "op9_suffix_dedup": (suffix_dedup.op9_suffix_dedup, None),
    "op10_quality_rules": (quality_rules.op10_quality_rules, quality_rules.OP10_SQL),
    "op11_pii": (pii.op11_pii, None),
    "op12_collocations": (collocations.op12_collocations, collocations.OP12_SQL),
    "op13_embedding_whitening": (whitening.op13_embedding_whitening, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _OPERATORS.items() if sql}
