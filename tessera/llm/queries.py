"""Registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm import (bpe, conversations, decontaminate, fingerprint, html_text, jaccard, licenses, merkle, quality, secrets,
                         toxicity, url_filter, warc)

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_licenses": licenses.op2_licenses,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_secrets": secrets.op4_secrets,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_quality": quality.op6_quality,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_html_text": html_text.op9_html_text,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_warc": warc.op12_warc,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
