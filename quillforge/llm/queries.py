"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillforge.llm import alignment, dart_minhash, decontamination, interpolation, licenses, mixing, pii, substring_dedup, token_counts, token_files, toxicity, whitening, winnowing

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_spaced_seeds": decontamination.op2_spaced_seeds,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_semi_markov": pii.op5_semi_markov,
    "op6_dart_minhash": dart_minhash.op6_dart_minhash,
    "op7_license_index": licenses.op7_license_index,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_token_files": token_files.op10_token_files,
    "op11_deleted_interpolation": interpolation.op11_deleted_interpolation,
    "op12_cholesky_whitening": whitening.op12_cholesky_whitening,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
}
