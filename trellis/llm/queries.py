"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from trellis.llm import bpe, decontam, exact_dedup, line_dedup, lm, merkle, mixing, near_dedup, quality, runs, sharding, token_counts, toxicity

QUERIES = {
    "op1_deletion_neighbourhood": line_dedup.query,
    "op2_sampled_splitters": sharding.query,
    "op3_dart_minhash": near_dedup.query,
    "op4_longest_match_counts": token_counts.query,
    "op5_multinomial_mixing": mixing.query,
    "op6_kneser_ney": lm.query,
    "op7_latent_decontamination": decontam.query,
    "op8_hierarchical_quality": quality.query,
    "op9_streaming_exact_dedup": exact_dedup.query,
    "op10_segment_toxicity": toxicity.query,
    "op11_merkle_manifest": merkle.query,
    "op12_prefix_bpe": bpe.query,
    "op13_periodic_runs": runs.query,
}

SQL = {
    "op9_streaming_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
