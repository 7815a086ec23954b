"""Queries over the corpus operators: name to function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op8_bpe_automaton
from .html_text import op9_html_lineblocks
from .langid import op2_langid_nb
from .mih import op3_multi_index_hashing
from .mixing import op5_mixing_ipf
from .neardup import op4_order_minhash
from .quality_model import op10_quality_weaklabel
from .quality_rules import op7_quality_rules
from .sharding import op6_size_tiered_shards
from .toxicity import op1_toxicity_fm

QUERIES = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_langid_nb": op2_langid_nb,
    "op3_multi_index_hashing": op3_multi_index_hashing,
    "op4_order_minhash": op4_order_minhash,
    "op5_mixing_ipf": op5_mixing_ipf,
    "op6_size_tiered_shards": op6_size_tiered_shards,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_html_lineblocks": op9_html_lineblocks,
    "op10_quality_weaklabel": op10_quality_weaklabel,
}

ORACLE_SQL: dict[str, str] = {}
