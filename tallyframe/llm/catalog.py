"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, hard_negatives, line_dedup, prefix_join
from .byte_bpe import op4_byte_bpe
from .centroids import op11_sort_means
from .decontamination import op5_decontamination
from .hard_negatives import op12_hard_negatives
from .html_text import op6_html_extraction
from .language import op3_language_id
from .licences import op7_license_scan
from .line_dedup import op8_line_dedup
from .multiset_hash import op9_fingerprint
from .prefix_join import op1_prefix_join
from .private_data import op10_private_data
from .sentence_pieces import op13_sentencepiece
from .sharding import op2_sharding


OPERATORS = (
    op1_prefix_join, op2_sharding, op3_language_id, op4_byte_bpe, op5_decontamination, op6_html_extraction, op7_license_scan, op8_line_dedup, op9_fingerprint,
    op10_private_data, op11_sort_means, op12_hard_negatives, op13_sentencepiece,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_prefix_join": prefix_join.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_sort_means": centroids.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
