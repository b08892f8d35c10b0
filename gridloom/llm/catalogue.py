"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from gridloom.llm import bpe, chat, fingerprint, jaccard, mixing, quality, token_file, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_fingerprints": fingerprint.op2_fingerprints,
        "op3_chat": chat.op3_chat,
        "op4_warc": warc.op4_warc,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_bpe": bpe.op6_bpe,
        "op7_token_file": token_file.op7_token_file,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_topk": topk.op9_topk,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op4_warc": warc.OP4_SQL, "op9_topk": topk.OP9_SQL, "op10_mixing": mixing.OP10_SQL}
