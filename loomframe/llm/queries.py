"""The corpus operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomframe.llm import bfd, chunk_dedup, exact_dedup, filter_audit, html_text, mixing, packing, privacy, quality, reply_trees, simhash, vector_codes, warc


def queries():
    return {
        "op1_packing": packing.query,
        "op2_warc": warc.query,
        "op3_quality_rules": quality.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_substring_dedup": chunk_dedup.query,
        "op6_html_extraction": html_text.query,
        "op7_privacy": privacy.query,
        "op8_mixing": mixing.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_bfd_packing": bfd.query,
        "op11_vector_codes": vector_codes.query,
        "op12_chat_formatting": reply_trees.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql():
    return {"op2_warc": warc.SQL, "op4_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op11_vector_codes": vector_codes.SQL, "op12_chat_formatting": reply_trees.SQL, "op13_filter_audit": filter_audit.SQL}
