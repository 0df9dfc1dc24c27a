"""The queries of the operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from tabulon.llm import bpe, chat, embeddings, fim, fingerprints, langid, licenses, mixing, prefix_trie, repeats, sharding, simhash, token_counts

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_chat_format": chat.op5_chat_format,
    "op6_sharding": sharding.op6_sharding,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op8_embedding_dedup": embeddings.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_suffix_dedup": repeats.ORACLE,
}
