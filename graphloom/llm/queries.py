"""Queries opN_<name> over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .decontaminate import op10_benchmark_decontamination
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op8_language_id
from .line_dedup import op7_line_dedup
from .near_dedup import op1_minhash_near_dedup
from .secrets import op6_secret_scan
from .sharding import op9_lpt_sharding
from .toxicity import op5_toxicity
from .url_filter import op3_url_filter

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_lpt_sharding": op9_lpt_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
ORACLE = {"op2_exact_dedup": OP2_SQL}
