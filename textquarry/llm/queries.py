"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from . import binary_ids, ctw, decontam, embeddings, html_extract, langid, minhash, spm, toxicity, urlfilter

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_benchmark_decontamination": decontam.op2_benchmark_decontamination,
    "op3_url_filters": urlfilter.op3_url_filters,
    "op4_sentencepiece": spm.op4_sentencepiece,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_token_files": binary_ids.op9_token_files,
    "op10_lm_scoring": ctw.op10_lm_scoring,
}
ORACLES = {
    "op2_benchmark_decontamination": decontam.ORACLE,
    "op3_url_filters": urlfilter.ORACLE,
    "op7_embedding_near_dedup": embeddings.ORACLE,
}
