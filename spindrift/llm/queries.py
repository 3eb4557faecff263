"""The training-data queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .chat import op8_chat_format
from .fingerprint import op3_multiset_hash
from .html import op1_text_density
from .linedup import OP6_SQL, op6_line_windows
from .packing import op10_best_fit_pack
from .quality import OP4_SQL, op4_quality_cascade
from .shards import op9_jump_shards
from .simhash import op5_simhash_groups
from .substrings import OP2_SQL, op2_unit_dedup

QUERIES = {
    "op1_text_density": op1_text_density,
    "op2_unit_dedup": op2_unit_dedup,
    "op3_multiset_hash": op3_multiset_hash,
    "op4_quality_cascade": op4_quality_cascade,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_line_windows": op6_line_windows,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_chat_format": op8_chat_format,
    "op9_jump_shards": op9_jump_shards,
    "op10_best_fit_pack": op10_best_fit_pack,
}
ORACLES: dict[str, str] = {"op2_unit_dedup": OP2_SQL, "op4_quality_cascade": OP4_SQL, "op6_line_windows": OP6_SQL}
