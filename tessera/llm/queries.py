"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from tessera.llm import brown_lm, fingerprints, langid, licenses, line_dedup, mixing, packing, pii, simhash_dedup, topk


def queries() -> dict:
    return {
        "op1_redact_pii": pii.op1_redact_pii,
        "op2_identify_language": langid.op2_identify_language,
        "op3_fingerprint": fingerprints.op3_fingerprint,
        "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_retrieval_packing": packing.op6_retrieval_packing,
        "op7_license_lookup": licenses.op7_license_lookup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_class_lm": brown_lm.op9_class_lm,
        "op10_topk_inner_product": topk.op10_topk_inner_product,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the query; tests hold the others against brute-force versions."""
    return {
        "op7_license_lookup": licenses.OP7_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
        "op10_topk_inner_product": topk.OP10_SQL,
    }
