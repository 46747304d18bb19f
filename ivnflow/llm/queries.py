"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .composite_density import op2_composite_density
from .conversation_repair import op11_viterbi_repair
from .host_rules import OP1_SQL, op1_host_rules
from .importance_resampling import OP12_SQL, op12_radix_resampling
from .language_evidence import op6_language_evidence
from .nnls_packing import op8_nnls_packing
from .pii_boosting import op13_pii_boosting
from .secret_ownership import OP3_SQL, op3_secret_ownership
from .simhash_bktree import op5_simhash_bktree
from .slot_sharding import op7_slot_sharding
from .syncmers import op4_syncmers
from .url_lists import OP9_SQL, op9_url_lists

QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_composite_density": op2_composite_density,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_syncmers": op4_syncmers,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_language_evidence": op6_language_evidence,
    "op7_slot_sharding": op7_slot_sharding,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_url_lists": op9_url_lists,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_viterbi_repair": op11_viterbi_repair,
    "op12_radix_resampling": op12_radix_resampling,
    "op13_pii_boosting": op13_pii_boosting,
}

ORACLES = {
    "op1_host_rules": OP1_SQL,
    "op3_secret_ownership": OP3_SQL,
    "op9_url_lists": OP9_SQL,
    "op12_radix_resampling": OP12_SQL,
}
