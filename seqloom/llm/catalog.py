"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import anchors, decontaminate, kneser_ney, language, licences, line_runs, matrix_search, merkle, packing, periodic, ring, toxicity, url_rules


def queries() -> dict:
    return {
        "op1_kneser_ney": kneser_ney.op1_kneser_ney,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_kernel_toxicity": toxicity.op3_kernel_toxicity,
        "op4_line_dedup": line_runs.op4_line_dedup,
        "op5_simhash_anchors": anchors.op5_simhash_anchors,
        "op6_url_rules": url_rules.op6_url_rules,
        "op7_qgram_decontamination": decontaminate.op7_qgram_decontamination,
        "op8_int8_block_join": matrix_search.op8_int8_block_join,
        "op9_ring_shards": ring.op9_ring_shards,
        "op10_zstd_language": language.op10_zstd_language,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_licence_index": licences.op12_licence_index,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_runs.OP4_SQL, "op8_int8_block_join": matrix_search.OP8_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_licence_index": licences.OP12_SQL}
