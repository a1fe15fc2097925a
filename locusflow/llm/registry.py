"""The queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from locusflow.llm import bpe, chat, divergence, extract, jaccard, media, mixing, oracle, quality, repair, rlz, tokens, toxicity, warc

_QUERIES: dict[str, Callable] = {
    "op1_substring_dedup": rlz.query,
    "op2_media_jpeg": media.query,
    "op3_html_text": extract.query,
    "op4_quality_rules": quality.query,
    "op5_token_counts": tokens.query,
    "op6_warc": warc.query,
    "op7_byte_bpe": bpe.query,
    "op8_toxicity": toxicity.query,
    "op9_ngram_jaccard": jaccard.query,
    "op10_source_mix": mixing.query,
    "op11_conversation_repair": repair.query,
    "op12_chat_format": chat.query,
    "op13_source_divergence": divergence.query,
}
_QUERIES["pipeline"] = corpus_pipeline.run
_ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op4_quality_rules": oracle.QUALITY,
    "op6_warc": oracle.WARC,
    "op9_ngram_jaccard": oracle.JACCARD,
    "op11_conversation_repair": oracle.REPAIR,
    "op12_chat_format": oracle.CHAT,
    "op13_source_divergence": oracle.DIVERGENCE,
}


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
