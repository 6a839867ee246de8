"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from .bpe_coding import op10_bpe_coding
from .collocations import OP13_SQL, op13_collocations
from .fingerprints import op7_fingerprints
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .language_id import op2_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .main_text import op6_main_text
from .merkle import OP11_SQL, op11_merkle_manifest
from .neighbours import op12_neighbours
from .packing import op5_packing
from .quality_classifier import op1_quality_classifier
from .quality_rules import op9_quality_rules
from .secrets import OP8_SQL, op8_secrets

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_main_text": op6_main_text,
    "op7_fingerprints": op7_fingerprints,
    "op8_secrets": op8_secrets,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe_coding": op10_bpe_coding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_neighbours": op12_neighbours,
    "op13_collocations": op13_collocations,
}
SQL = {"op3_jaccard_join": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_secrets": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
