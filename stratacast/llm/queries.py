"""Registry of this subpackage's queries and their DuckDB equivalents."""

from __future__ import annotations

from . import archives, decontaminate, embeddings, language, lm, merkle, mixing, pagetext, quality, secrets, simhash, trie, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_arc_to_warc": archives.op3_arc_to_warc,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_page_text": pagetext.op5_page_text,
    "op6_url_rules": urls.op6_url_rules,
    "op7_winnowing": decontaminate.op7_winnowing,
    "op8_importance": quality.op8_importance,
    "op9_secrets": secrets.op9_secrets,
    "op10_language": language.op10_language,
    "op11_merkle": merkle.op11_merkle,
    "op12_trie": trie.op12_trie,
    "op13_log_bilinear": lm.op13_log_bilinear,
}
ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_arc_to_warc": archives.OP3_SQL,
    "op4_embeddings": embeddings.OP4_SQL,
    "op5_page_text": pagetext.OP5_SQL,
    "op6_url_rules": urls.OP6_SQL,
    "op7_winnowing": decontaminate.OP7_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_trie": trie.OP12_SQL,
}
