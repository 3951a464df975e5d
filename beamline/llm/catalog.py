"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import exact_dedup, importance, jaccard_join, language_crf, line_dedup, lm_score, minhash_dedup, mixing, piece_codec, prefix_trie, token_orc, topk_search, url_filter

QUERIES = {
    "op1_token_orc": token_orc.op1_token_orc,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_mixing": mixing.op3_mixing,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_language_crf": language_crf.op5_language_crf,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_piece_codec": piece_codec.op8_piece_codec,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_importance": importance.op11_importance,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
}

SQL = {
    "op2_topk_search": topk_search.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_importance": importance.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
