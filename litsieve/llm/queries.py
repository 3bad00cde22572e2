"""The queries of the corpus operators and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm import byte_pairs, clustering, embeddings, media, packing, pieces, preferences, repair, sharding, simhash, suffix_dedup, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_embedding_neardup": embeddings.op4_embedding_neardup,
    "op5_simhash": simhash.op5_simhash,
    "op6_preference_formatting": preferences.op6_preference_formatting,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_label_propagation_sharding": sharding.op8_label_propagation_sharding,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_media_columns": media.op10_media_columns,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_bpe_transducer": byte_pairs.op12_bpe_transducer,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op4_embedding_neardup": embeddings.ORACLE,
    "op6_preference_formatting": preferences.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
