"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tabulon.llm import audio, bpe, dedup, langid, mixing, ngram_join, preferences, quality, tokencount, urls


def queries() -> dict:
    return {
        "op1_url_language_model": urls.op1,
        "op2_ngram_jaccard": ngram_join.op2,
        "op3_poisson_mix": mixing.op3,
        "op4_language_spans": langid.op4,
        "op5_telephony_audio": audio.op5,
        "op6_preference_format": preferences.op6,
        "op7_exact_dedup": dedup.op7,
        "op8_byte_bpe": bpe.op8,
        "op9_token_counts": tokencount.op9,
        "op10_quality_ranking": quality.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": ngram_join.SQL,
        "op3_poisson_mix": mixing.SQL,
        "op6_preference_format": preferences.SQL,
        "op7_exact_dedup": dedup.SQL,
    }
