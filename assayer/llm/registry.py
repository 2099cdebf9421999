"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from assayer.llm import bpe, chat, language, licenses, matroska, near_dedup, packing, pieces, prefix_trie, quality_classifier, quality_rules, repair, substring_dedup

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "unigram_pieces": pieces.unigram_pieces,
    "op2_packing": packing.op2_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_language_id": language.op7_language_id,
    "op8_matroska": matroska.op8_matroska,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_chat_format": chat.op10_chat_format,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_bpe": bpe.op13_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op9_license_scan": licenses.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_structure_repair": repair.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
