"""All queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .line_runs import op8_line_runs
from .mixing import MIXING_SQL, op1_source_mixing
from .quality import op4_quality_gam
from .suffix_dedup import op9_suffix_dedup
from .token_planes import op5_token_planes
from .toxicity import op2_toxic_clauses
from .block_search import op3_block_search
from .decontaminate import op6_decontaminate
from .language import op10_language
from .near_dup import op7_near_dup
from .filter_audit import AUDIT_SQL, op13_filter_audit
from .resampling import RESAMPLING_SQL, op12_importance_resampling
from .secret_scan import op11_secret_scan

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxic_clauses": op2_toxic_clauses,
    "op3_block_search": op3_block_search,
    "op4_quality_gam": op4_quality_gam,
    "op5_token_planes": op5_token_planes,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_dup": op7_near_dup,
    "op8_line_runs": op8_line_runs,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language": op10_language,
    "op11_secret_scan": op11_secret_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {"op1_source_mixing": MIXING_SQL, "op12_importance_resampling": RESAMPLING_SQL, "op13_filter_audit": AUDIT_SQL}
