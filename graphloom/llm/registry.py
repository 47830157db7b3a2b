"""The driver queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat, exact_dedup, html_text, media, minhash, packing, pii, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_chat": chat.op2_chat,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_minhash": minhash.op4_minhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_media": media.op7_media,
        "op8_html_text": html_text.op8_html_text,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.OP2_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL}
