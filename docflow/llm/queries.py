"""Queries of this subpackage by name. None of them can be said in SQL; README says what each is held against in tests/llm."""

from __future__ import annotations

from .bpe import op10_bpe
from .contamination import op9_decontamination
from .edits import op7_token_counts
from .fingerprints import op1_fingerprints
from .html import op5_html
from .jaccard import op8_jaccard
from .languages import op2_languages
from .merkle import op12_merkle
from .pieces import op13_pieces
from .privacy import op4_privacy
from .repeats import op6_substrings
from .toxicity import op3_toxicity
from .whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_languages, op3_toxicity, op4_privacy, op5_html, op6_substrings, op7_token_counts, op8_jaccard, op9_decontamination, op10_bpe, op11_whitening, op12_merkle, op13_pieces)}
ORACLE_SQL: dict[str, str] = {}
