"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat, collisions, collocations, decontaminate, language, packing, quality, secrets, simhash, substrings, toxicity, treaps, urls


def queries() -> dict:
    return {
        "op1_toxicity_crf": toxicity.query,
        "op2_decontaminate": decontaminate.query,
        "op3_packing": packing.query,
        "op4_language_id": language.query,
        "op5_chat_format": chat.query,
        "op6_simhash": simhash.query,
        "op7_quality_rules": quality.query,
        "op8_suffix_dedup": substrings.query,
        "op9_secret_scan": secrets.query,
        "op10_url_filter": urls.query,
        "op11_collocations": collocations.query,
        "op12_collision_search": collisions.query,
        "op13_treap_search": treaps.query,
        # the parts of three of them that SQL can express
        "quality_base_counts": quality.base_counts,
        "secret_base_spans": secrets.base_spans,
        "url_rules": urls.url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.oracle_sql(),
        "op5_chat_format": chat.oracle_sql(),
        "op8_suffix_dedup": substrings.oracle_sql(),
        "op11_collocations": collocations.oracle_sql(),
        "op13_treap_search": treaps.oracle_sql(),
        "quality_base_counts": quality.oracle_sql(),
        "secret_base_spans": secrets.oracle_sql(),
        "url_rules": urls.oracle_sql(),
    }
