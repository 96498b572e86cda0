"""Queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from gradelake.llm.centroids import OP12_SQL, op12_centroid_clustering
from gradelake.llm.chat_format import OP1_SQL, op1_chat_format
from gradelake.llm.decontamination import OP3_SQL, op3_decontamination
from gradelake.llm.html_extract import op6_html_extract
from gradelake.llm.license_scan import OP5_SQL, op5_license_scan
from gradelake.llm.line_dedup import OP10_SQL, op10_line_dedup
from gradelake.llm.packing import op8_best_fit_packing
from gradelake.llm.quality_rules import OP7_SQL, op7_quality_rules
from gradelake.llm.resampling import OP13_SQL, op13_importance_resampling
from gradelake.llm.sharding import OP4_SQL, op4_sharding
from gradelake.llm.simhash import op2_simhash
from gradelake.llm.token_counts import op9_token_counts
from gradelake.llm.topk import OP11_SQL, op11_exact_top_k


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_simhash, op3_decontamination, op4_sharding, op5_license_scan, op6_html_extract, op7_quality_rules, op8_best_fit_packing, op9_token_counts, op10_line_dedup, op11_exact_top_k, op12_centroid_clustering, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_sharding": OP4_SQL, "op5_license_scan": OP5_SQL, "op7_quality_rules": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_exact_top_k": OP11_SQL, "op12_centroid_clustering": OP12_SQL, "op13_importance_resampling": OP13_SQL}
