"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import (
    exact_dedup, fill_middle, fingerprints, html_text, language, mixing, near_dup, periodic_runs, pieces, quality, sharding, token_counts,
    toxicity,
)

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_quality": quality.op5_quality,
    "op6_html_text": html_text.op6_html_text,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language": language.op9_language,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}
ORACLES = {"op8_exact_dedup": exact_dedup.OP8_SQL, "op12_fill_in_middle": fill_middle.OP12_SQL}
