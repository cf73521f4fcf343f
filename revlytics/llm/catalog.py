"""The queries of this subpackage, by name."""

from __future__ import annotations

from revlytics.llm import chat, clusters, tries
from revlytics.llm.bpe import op7_bpe_round_trip
from revlytics.llm.media import op5_media_chunks
from revlytics.llm.packing import op6_best_fit_packing
from revlytics.llm.pii import op8_pii_surrogates
from revlytics.llm.quality_classifier import op10_quality_classifier
from revlytics.llm.quality_rules import op9_quality_rules
from revlytics.llm.secrets import op4_secret_scan
from revlytics.llm.sharding import op1_minimax_sharding
from revlytics.llm.simhash import op2_simhash_near_dedup
from revlytics.llm.substrings import op3_suffix_dedup

QUERIES = (op1_minimax_sharding, op2_simhash_near_dedup, op3_suffix_dedup, op4_secret_scan, op5_media_chunks, op6_best_fit_packing, op7_bpe_round_trip, op8_pii_surrogates, op9_quality_rules, op10_quality_classifier, chat.op11_chat_round_trip, tries.op12_conversation_trie, clusters.op13_centroid_clusters)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_chat_round_trip": chat.SQL, "op12_conversation_trie": tries.SQL, "op13_centroid_clusters": clusters.SQL}
