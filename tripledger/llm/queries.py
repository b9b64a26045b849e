"""Queries of this subpackage by name, with the DuckDB SQL that checks them where SQL can."""

from __future__ import annotations

from tripledger.llm import bpe, embedding_join, exact_dedup, html_extract, language_id, mixing, ngram_join, prefix_trie, secret_scan, spelling, stream_bpe, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_embedding_join": embedding_join.op2,
        "op3_secret_scan": secret_scan.op3,
        "op4_token_counts": token_counts.op4,
        "op5_html_extract": html_extract.op5,
        "op6_ngram_join": ngram_join.op6,
        "op7_toxicity": toxicity.op7,
        "op8_language_id": language_id.op8,
        "op9_bpe": bpe.op9,
        "op10_mixing": mixing.op10,
        "op11_stream_bpe": stream_bpe.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_spelling": spelling.op13,
        "secret_base_spans": secret_scan.base_spans,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_embedding_join": embedding_join.OP2_SQL,
        "op6_ngram_join": ngram_join.OP6_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
        "secret_base_spans": secret_scan.BASE_SQL,
    }
