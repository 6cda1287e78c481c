"""Queries of the training-data operators and the SQL that repeats them where SQL can."""

from __future__ import annotations

from alphaloom.llm import centroids, chat, decontaminate, html, langid, linededup, neardup, packing, periods, quality, sharding, suffixdedup, topk

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_suffix_array_dedup": suffixdedup.op9_suffix_array_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLE_SQL = {"op3_decontamination": decontaminate.ORACLE, "op4_minhash_near_dedup": neardup.ORACLE, "op5_exact_top_k": topk.ORACLE, "op8_line_dedup": linededup.ORACLE, "op11_chat_formatting": chat.ORACLE, "op12_periodic_runs": periods.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
