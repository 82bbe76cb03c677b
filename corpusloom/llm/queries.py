"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from corpusloom.llm import bpe, exact_dedup, jaccard, mixing, packing, periodic_runs, pii, quality, sharding, suffix_dedup, token_counts, toxicity
from corpusloom.llm._common import documents, labels


def op1_classifier_chain(spark, sf_dir):
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_risk_controlled_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_weak_supervision(spark, sf_dir):
    return pii.find_personal_data(documents(spark, sf_dir))


def op4_lpt_shards(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_retrieval_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_chunk_recipes(spark, sf_dir):
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op7_cover_suffixes(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op8_separator_scan(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_two_tier_bpe(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_group_join(spark, sf_dir):
    return jaccard.join_components(documents(spark, sf_dir))


def op11_harmonic_grid(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.planted(documents(spark, sf_dir))))


def op12_hash_threshold_mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_classifier_chain, op2_risk_controlled_rules, op3_weak_supervision, op4_lpt_shards, op5_retrieval_packing, op6_chunk_recipes, op7_cover_suffixes, op8_separator_scan, op9_two_tier_bpe, op10_token_group_join, op11_harmonic_grid, op12_hash_threshold_mix)}

ORACLES = {"op6_chunk_recipes": exact_dedup.ORACLE, "op12_hash_threshold_mix": mixing.ORACLE}
