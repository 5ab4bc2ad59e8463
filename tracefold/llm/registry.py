"""Queries of the training-text operators."""

from __future__ import annotations

from .decontam import op10_decontamination
from .exactdedup import OP3_SQL, op3_exact_dedup
from .html import op4_html_extraction
from .langid import op8_language_id
from .linededup import OP6_SQL, op6_line_dedup
from .lm import op9_lm_scoring
from .minhash import op2_minhash_near_dedup
from .packing import op1_packing
from .quality import op5_quality
from .runs import op11_periodic_runs
from .spelling import OP13_SQL, op13_spelling_variants
from .tokenfile import op12_token_files
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op13_spelling_variants": OP13_SQL,
}
