"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from .co_training import op6_co_training
from .glr_repair import OP12_SQL, op12_glr_repair
from .hilbert_ann import op4_hilbert_ann
from .hmm_scoring import op1_hmm_scoring
from .line_dedup import OP3_SQL, op3_line_dedup
from .max_sketch import OP11_SQL, op11_max_sketch
from .minhash_dedup import OP8_SQL, op8_minhash_dedup
from .packing import op5_packing
from .quality_rules import OP10_SQL, op10_quality_rules
from .secret_scan import op9_secret_scan
from .soft_mixing import op7_soft_mixing
from .suffix_dedup import OP13_SQL, op13_suffix_dedup
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_hmm_scoring": op1_hmm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_hilbert_ann": op4_hilbert_ann,
    "op5_packing": op5_packing,
    "op6_co_training": op6_co_training,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_max_sketch": op11_max_sketch,
    "op12_glr_repair": op12_glr_repair,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_max_sketch": OP11_SQL,
    "op12_glr_repair": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
