"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, divergence_audit, fill_in_middle, language_id, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash, url_filter, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_sharding": sharding.op4_sharding,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_warc_derivatives": warc.op7_warc_derivatives,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_simhash": simhash.op9_simhash,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_divergence_audit": divergence_audit.op11_divergence_audit,
        "op12_language_id": language_id.op12_language_id,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op5_decontamination": decontamination.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op11_divergence_audit": divergence_audit.ORACLE_SQL,
        "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
    }
