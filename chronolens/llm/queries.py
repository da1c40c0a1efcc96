"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import fertility, hnsw, lexical, line_dedup, near_dedup, packing, passages, periodic, piece_bpe, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_best_fit": packing.op2_best_fit,
    "op3_histogram_topk": topk.op3_histogram_topk,
    "op4_piece_bpe": piece_bpe.op4_piece_bpe,
    "op5_attention_gru": toxicity.op5_attention_gru,
    "op6_compact_windows": passages.op6_compact_windows,
    "op7_shard_graphs": hnsw.op7_shard_graphs,
    "op8_line_windows": line_dedup.op8_line_windows,
    "op9_forest_secrets": secrets.op9_forest_secrets,
    "op10_chosen_path": near_dedup.op10_chosen_path,
    "op11_harmonic_runs": periodic.op11_harmonic_runs,
    "op12_shard_wand": lexical.op12_shard_wand,
    "op13_fertility_bands": fertility.op13_fertility_bands,
}

ORACLE_SQL = {
    "op3_histogram_topk": topk.OP3_SQL,
    "op8_line_windows": line_dedup.OP8_SQL,
    "op12_shard_wand": lexical.OP12_SQL,
}
