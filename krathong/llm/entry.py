"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversation_repair, decontaminate, html_extract, jaccard_join, mixing, quality_rank, quality_rules, secret_scan, simhash_dedup, toxicity, transcripts, vector_codes, warc_derive


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            warc_derive.op1_warc_derivatives,
            quality_rules.op2_crf_quality,
            simhash_dedup.op3_simhash_deletion,
            secret_scan.op4_blob_ledger,
            quality_rank.op5_bradley_terry,
            toxicity.op6_text_cnn,
            html_extract.op7_tag_ratio,
            mixing.op8_mix_thresholds,
            transcripts.op9_transcript_hmm,
            decontaminate.op10_window_simhash,
            jaccard_join.op11_ngram_jaccard,
            conversation_repair.op12_conversation_repair,
            vector_codes.op13_vector_codes,
        )
    }


def oracle_sql() -> dict:
    return {"op4_blob_ledger": secret_scan.ORACLE, "op8_mix_thresholds": mixing.ORACLE, "op11_ngram_jaccard": jaccard_join.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
