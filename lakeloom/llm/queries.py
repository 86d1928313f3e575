"""Registry of this subpackage's queries and of their SQL for DuckDB."""

from . import bpe, divergence, embedding_dedup, exact_dedup, html_extraction, language_id, licenses, minhash_dedup, mixing, packing, resampling, secrets, toxicity

from .common import small_batches

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_language_id": language_id.op2_language_id,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_license_sentences": licenses.op4_license_sentences,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_packing": packing.op11_packing,
    "op12_target_resampling": resampling.op12_target_resampling,
    "op13_source_divergence": divergence.op13_source_divergence,
}

QUERIES = {name: small_batches(query) for name, query in QUERIES.items()}

#: The others learn from data, compare sets of shingles or follow a vocabulary file; tests/llm holds them against brute force.
ORACLE = {
    "op4_license_sentences": licenses.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op8_embedding_dedup": embedding_dedup.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
