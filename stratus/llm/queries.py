"""Queries of the operators over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from stratus.llm import class_lm, conversations, crf_quality, cuckoo, kneser_ney, line_dedup, merkle, near_dup, packing, secret_scan, sentence_pieces, suffix_index, token_blocks

QUERIES = {
    "op1_near_dup": near_dup.query,
    "op2_packing": packing.query,
    "op3_token_blocks": token_blocks.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sentence_pieces": sentence_pieces.query,
    "op6_quality_crf": crf_quality.query,
    "op7_exact_dedup": cuckoo.query,
    "op8_kneser_ney": kneser_ney.query,
    "op9_secret_scan": secret_scan.query,
    "op10_suffix_dedup": suffix_index.query,
    "op11_merkle_manifest": merkle.query,
    "op12_conversation_repair": conversations.query,
    "op13_class_lm": class_lm.query,
}
ORACLES = {"op7_exact_dedup": cuckoo.SQL, "op11_merkle_manifest": merkle.SQL}
