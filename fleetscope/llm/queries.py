"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from fleetscope.llm import q_bm25_packing, q_byte_bpe, q_exact_dedup, q_language_mixture, q_license_index, q_merkle_manifest, q_pii_votes, q_quality_mil, q_simhash_pivots, q_spectral_whitening, q_template_leaks, q_warc_writer, q_wavelet_tokens

QUERIES = {
    "op1_template_leaks": q_template_leaks.op1_template_leaks,
    "op2_quality_mil": q_quality_mil.op2_quality_mil,
    "op3_pii_votes": q_pii_votes.op3_pii_votes,
    "op4_warc_writer": q_warc_writer.op4_warc_writer,
    "op5_language_mixture": q_language_mixture.op5_language_mixture,
    "op6_wavelet_tokens": q_wavelet_tokens.op6_wavelet_tokens,
    "op7_exact_dedup": q_exact_dedup.op7_exact_dedup,
    "op8_simhash_pivots": q_simhash_pivots.op8_simhash_pivots,
    "op9_license_index": q_license_index.op9_license_index,
    "op10_bm25_packing": q_bm25_packing.op10_bm25_packing,
    "op11_spectral_whitening": q_spectral_whitening.op11_spectral_whitening,
    "op12_byte_bpe": q_byte_bpe.op12_byte_bpe,
    "op13_merkle_manifest": q_merkle_manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op4_warc_writer": q_warc_writer.SQL,
    "op7_exact_dedup": q_exact_dedup.SQL,
    "op13_merkle_manifest": q_merkle_manifest.SQL,
}
