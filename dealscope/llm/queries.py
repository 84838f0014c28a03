"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from dealscope.llm import (
    op1_packing,
    op2_ngram_jaccard,
    op3_license_scan,
    op4_pii,
    op5_suffix_dedup,
    op6_quality_rules,
    op7_exact_dedup,
    op8_url_filter,
    op9_mixing,
    op10_quality_classifier,
    op11_ranked_search,
    op12_token_alignment,
    op13_html_text,
)


def queries() -> dict:
    return {
        "op1_packing": op1_packing.op1_packing,
        "op2_ngram_jaccard": op2_ngram_jaccard.op2_ngram_jaccard,
        "op3_license_scan": op3_license_scan.op3_license_scan,
        "op4_pii": op4_pii.op4_pii,
        "op5_suffix_dedup": op5_suffix_dedup.op5_suffix_dedup,
        "op6_quality_rules": op6_quality_rules.op6_quality_rules,
        "op7_exact_dedup": op7_exact_dedup.op7_exact_dedup,
        "op8_url_filter": op8_url_filter.op8_url_filter,
        "op9_mixing": op9_mixing.op9_mixing,
        "op10_quality_classifier": op10_quality_classifier.op10_quality_classifier,
        "op11_ranked_search": op11_ranked_search.op11_ranked_search,
        "op12_token_alignment": op12_token_alignment.op12_token_alignment,
        "op13_html_text": op13_html_text.op13_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": op2_ngram_jaccard.ORACLE,
        "op3_license_scan": op3_license_scan.ORACLE,
        "op5_suffix_dedup": op5_suffix_dedup.ORACLE,
        "op6_quality_rules": op6_quality_rules.ORACLE,
        "op7_exact_dedup": op7_exact_dedup.ORACLE,
        "op8_url_filter": op8_url_filter.ORACLE,
        "op9_mixing": op9_mixing.ORACLE,
        "op11_ranked_search": op11_ranked_search.ORACLE,
    }
