"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunk_dedup, cohorts, exact_dedup, hard_negatives, lengths, mixing, near_dedup, sharding, suffix_dedup, topk, toxicity, transducer


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_exact_topk": topk.op2_exact_topk,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_token_counts": lengths.op5_token_counts,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substring_dedup": chunk_dedup.op8_substring_dedup,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_mixing": mixing.op10_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_cohorts": cohorts.op12_cohorts,
        "op13_transducer": transducer.op13_transducer,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": topk.OP2_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_cohorts": cohorts.OP12_SQL}
