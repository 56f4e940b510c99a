"""The queries of this package, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from quarry.llm import op07_mixing, op10_secrets, op12_sharding, op13_negatives
from quarry.llm.op01_repetition import op1_suffix_array_repetition
from quarry.llm.op02_sentencepiece import op2_sentencepiece_suffix_matching
from quarry.llm.op03_bagminhash import op3_bagminhash_near_dedup
from quarry.llm.op04_crf_quality import op4_crf_quality
from quarry.llm.op05_sketch import op5_scaled_sketch
from quarry.llm.op06_html import op6_layout_rendering
from quarry.llm.op07_mixing import op7_ipf_mixing
from quarry.llm.op08_substring import op8_substring_dedup
from quarry.llm.op09_token_counts import op9_separator_scan
from quarry.llm.op10_secrets import op10_trigram_secret_scan
from quarry.llm.op11_alignment import op11_token_alignment
from quarry.llm.op12_sharding import op12_virtual_slots
from quarry.llm.op13_negatives import op13_pivot_negatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_repetition, op2_sentencepiece_suffix_matching, op3_bagminhash_near_dedup, op4_crf_quality, op5_scaled_sketch,
        op6_layout_rendering, op7_ipf_mixing, op8_substring_dedup, op9_separator_scan, op10_trigram_secret_scan,
        op11_token_alignment, op12_virtual_slots, op13_pivot_negatives,
    )
}
ORACLES = {"op7_ipf_mixing": op07_mixing.oracle(), "op10_trigram_secret_scan": op10_secrets.oracle(), "op12_virtual_slots": op12_sharding.oracle(), "op13_pivot_negatives": op13_negatives.ORACLE}
