"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from parley.llm.byte_bpe import op9_scan_bpe
from parley.llm.language import op10_crf_language
from parley.llm.planes import op7_bit_planes
from parley.llm.prefixes import OP11_SQL, op11_prefix_doubling
from parley.llm.products import OP13_SQL, op13_norm_buckets
from parley.llm.quality import OP1_SQL, op1_rule_cascade
from parley.llm.repeats import op6_line_hashing
from parley.llm.simhash import op5_bit_sliced_simhash
from parley.llm.slots import op8_fixed_virtual_slots
from parley.llm.spellings import OP12_SQL, op12_parity_bands
from parley.llm.tiling import op2_string_tiling
from parley.llm.token_counts import op4_overlap_resync_counts
from parley.llm.toxicity import op3_lexicon_automata

QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_cascade,
        op2_string_tiling,
        op3_lexicon_automata,
        op4_overlap_resync_counts,
        op5_bit_sliced_simhash,
        op6_line_hashing,
        op7_bit_planes,
        op8_fixed_virtual_slots,
        op9_scan_bpe,
        op10_crf_language,
        op11_prefix_doubling,
        op12_parity_bands,
        op13_norm_buckets,
    )
}
ORACLE_SQL: dict[str, str] = {
    op1_rule_cascade.__name__: OP1_SQL,
    op11_prefix_doubling.__name__: OP11_SQL,
    op12_parity_bands.__name__: OP12_SQL,
    op13_norm_buckets.__name__: OP13_SQL,
}
