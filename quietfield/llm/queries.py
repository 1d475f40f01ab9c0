"""Queries over whole driver tables, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, centroids, exact_dedup, host_rules, html_text, langid, lm_score, mixing, packing, simhash, token_counts, token_files, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc_transactions,
        host_rules.op2_host_rules,
        langid.op3_language_id,
        token_files.op4_token_files,
        html_text.op5_main_text,
        simhash.op6_simhash_near_dedup,
        exact_dedup.op7_exact_dedup,
        mixing.op8_mixing,
        packing.op9_best_fit_packing,
        lm_score.op10_lm_score,
        token_counts.op11_token_counts,
        alignment.op12_token_alignment,
        centroids.op13_centroid_clusters,
    )
}

ORACLE_SQL = {
    "op1_warc_transactions": warc.OP1_SQL,
    "op2_host_rules": host_rules.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op13_centroid_clusters": centroids.OP13_SQL,
}
