"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op8_ann
from .bpe import op10_bpe
from .chat import OP11_SQL, op11_chat_format
from .fill_middle import OP13_SQL, op13_fill_middle
from .jaccard_join import op3_jaccard_join
from .language_id import op1_language_id
from .packing import op4_packing
from .pii import op7_pii
from .quality import op2_quality
from .quality_rules import OP9_SQL, op9_quality_rules
from .repeat_index import op5_suffix_dedup
from .sharding import op6_sharding
from .whitening import op12_whitening

QUERIES = {
    "op8_ann": op8_ann,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op10_bpe": op10_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op1_language_id": op1_language_id,
    "op6_sharding": op6_sharding,
    "op7_pii": op7_pii,
    "op9_quality_rules": op9_quality_rules,
    "op11_chat_format": op11_chat_format,
    "op12_whitening": op12_whitening,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES = {
    "op11_chat_format": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
    "op9_quality_rules": OP9_SQL,
}
