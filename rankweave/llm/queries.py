"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import chat_format, decontamination, fill_in_middle, jaccard_join
from .chat_format import op10_chat_format
from .decontamination import op7_decontamination
from .fill_in_middle import op12_fill_in_middle
from .html_extraction import op6_html_extraction
from .jaccard_join import op8_jaccard_join
from .lm_scoring import op9_lm_scoring
from .packing import op4_packing
from .pii import op3_pii
from .quality_classifier import op5_quality_classifier
from .quality_rules import op1_quality_rules
from .secret_scan import op13_secret_scan
from .token_alignment import op11_token_alignment
from .toxicity import op2_toxicity

_FUNCTIONS = (
    op1_quality_rules, op2_toxicity, op3_pii, op4_packing, op5_quality_classifier, op6_html_extraction, op7_decontamination, op8_jaccard_join, op9_lm_scoring, op10_chat_format,
    op11_token_alignment, op12_fill_in_middle, op13_secret_scan,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": decontamination.ORACLE_SQL, "op8_jaccard_join": jaccard_join.ORACLE_SQL, "op10_chat_format": chat_format.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
