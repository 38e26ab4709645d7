"""The queries of this folder and their SQL twins, as the driver calls them."""

from __future__ import annotations

from .code_compression import OP13_SQL, op13_code_compression
from .decontaminate import op2_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .jaccard_join import op9_jaccard_join
from .packing import op5_packing
from .pii import op10_pii
from .quality_classifier import op7_quality_classifier
from .quality_rules import OP6_SQL, op6_quality_rules
from .secret_scan import OP4_SQL, op4_secret_scan
from .substring_dedup import op1_substring_dedup
from .token_output import op3_token_output
from .topk_search import OP12_SQL, op12_topk_search
from .toxicity import op8_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_output": op3_token_output,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_topk_search": op12_topk_search,
    "op13_code_compression": op13_code_compression,
}

ORACLE_SQL = {
    "op4_secret_scan": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_topk_search": OP12_SQL,
    "op13_code_compression": OP13_SQL,
}
