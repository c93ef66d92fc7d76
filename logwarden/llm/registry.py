"""Queries and SQL twins of this package, by name."""

from __future__ import annotations

from logwarden.llm import fill_middle, fingerprints, language_id, line_dedup, lm_scores, mixing, nearest, ngram_join, packing, prefix_trie, pseudonyms, secret_scan, sharding

QUERIES = {
    "op1_nearest": nearest.op1_nearest,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_lm_scores": lm_scores.op4_lm_scores,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_pseudonyms": pseudonyms.op10_pseudonyms,
    "op11_sharding": sharding.op11_sharding,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op2_secret_scan": secret_scan.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_ngram_join": ngram_join.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op11_sharding": sharding.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
