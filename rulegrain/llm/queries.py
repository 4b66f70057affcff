"""The queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from . import (
    chat_format, chosen_path, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, merkle, packing, pseudonyms, quality,
    secrets, suffix_dedup,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_secrets": secrets.query,
    "op3_packing": packing.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality": quality.query,
    "op6_pseudonyms": pseudonyms.query,
    "op7_chat_format": chat_format.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_decontaminate": decontaminate.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_chosen_path": chosen_path.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_merkle": merkle.query,
}
ORACLES = {
    "op2_secrets": secrets.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_chosen_path": chosen_path.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
