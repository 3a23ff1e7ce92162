"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, fingerprint, forest, language, lines, minhash, mixing, packing, phrases, quality, repair, sharding, url_filter


def queries() -> dict[str, Callable]:
    return {
        "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
        "op2_fingerprints": fingerprint.op2_fingerprints,
        "op3_sharding": sharding.op3_sharding,
        "op3_sharding_manifest": sharding.op3_sharding_manifest,
        "op4_chat_format": chat.op4_chat_format,
        "op5_mixing": mixing.op5_mixing,
        "op6_embedding_near_dedup": forest.op6_embedding_near_dedup,
        "op7_packing": packing.op7_packing,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_language_id": language.op9_language_id,
        "op9_language_id_pages": language.op9_language_id_pages,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_quality_rules": quality.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.OP3_SQL, "op4_chat_format": chat.OP4_SQL, "op5_mixing": mixing.OP5_SQL, "op10_url_filter": url_filter.OP10_SQL, "op11_phrase_collocations": phrases.OP11_SQL, "op13_quality_rules": quality.OP13_SQL}
