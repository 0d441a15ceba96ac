"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from .context_mixing import op12_lm_score
from .fingerprint import op6_fingerprint
from .id_files import op9_id_files
from .language_id import op1_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .line_dedup import OP5_SQL, op5_line_dedup
from .near_dedup import OP3_SQL, op3_near_dedup
from .packing import op7_packing
from .periodic_runs import op13_periodic_runs
from .pii import op10_pii
from .prefix_bpe import op8_prefix_bpe
from .quality_mil import op2_quality_mil
from .quality_rules import OP4_SQL, op4_quality_rules

_ALL = (
    op1_language_id,
    op2_quality_mil,
    op3_near_dedup,
    op4_quality_rules,
    op5_line_dedup,
    op6_fingerprint,
    op7_packing,
    op8_prefix_bpe,
    op9_id_files,
    op10_pii,
    op11_lexical_search,
    op12_lm_score,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op3_near_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_line_dedup": OP5_SQL, "op11_lexical_search": OP11_SQL}
