"""Queries of the llm operators and the SQL they are held against."""

from wirelake.llm import decontaminate, exact_dedup, language_id, packing, pseudo_likelihood, secrets_scan, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_decontaminate": decontaminate.query,
    "op3_language_id": language_id.query,
    "op4_warc": warc.query,
    "op5_toxicity": toxicity.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_pseudo_likelihood": pseudo_likelihood.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_simhash": simhash.query,
    "op10_secret_scan": secrets_scan.query,
}
ORACLES = {
    "op4_warc": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
