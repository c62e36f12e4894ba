"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, media, mixing, near_dedup, packing, pii, quality, sharding, toxicity, urls

QUERIES = {
    "op1_jpeg_media": media.op1_jpeg_media,
    "op2_variable_best_fit": packing.op2_variable_best_fit,
    "op3_compression_toxicity": toxicity.op3_compression_toxicity,
    "op4_golden_ratio_mix": mixing.op4_golden_ratio_mix,
    "op5_multi_index_near_dedup": near_dedup.op5_multi_index_near_dedup,
    "op6_markov_url_filter": urls.op6_markov_url_filter,
    "op7_bilstm_crf_pii": pii.op7_bilstm_crf_pii,
    "op8_fourier_quality": quality.op8_fourier_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_stratified_shards": sharding.op10_stratified_shards,
}
ORACLES = mixing.ORACLE | exact_dedup.ORACLE | sharding.ORACLE
