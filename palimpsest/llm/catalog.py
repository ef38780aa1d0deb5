"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import chat, curriculum, hamming, language, packing, pii, pretokens, sharding, simhash, syncmers, toxicity, trie, whitening

QUERIES = {
    "op1_packing": packing.op1,
    "op2_simhash": simhash.op2,
    "op3_chat_format": chat.op3,
    "op4_language_id": language.op4,
    "op5_pii": pii.op5,
    "op6_toxicity": toxicity.op6,
    "op7_hamming_topk": hamming.op7,
    "op8_syncmers": syncmers.op8,
    "op9_token_counts": pretokens.op9,
    "op10_mixing": curriculum.op10,
    "op11_whitening": whitening.op11,
    "op12_prefix_trie": trie.op12,
    "op13_sharding": sharding.op13,
}
SQL = {"op3_chat_format": chat.SQL, "op7_hamming_topk": hamming.SQL}
