"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, langid, licences, mixing, nearjoin, packing, quality, resample, rules, secrets, sharding, topk

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_codes": langid.op1_language_codes,
        "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
        "op3_secret_novelty": secrets.op3_secret_novelty,
        "op4_exact_topk": topk.op4_exact_topk,
        "op5_decision_list": rules.op5_decision_list,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op10_quality_network": quality.op10_quality_network,
        "op7_licence_scan": licences.op7_licence_scan,
        "op8_ngram_jaccard": nearjoin.op8_ngram_jaccard,
        "op9_rendezvous_sharding": sharding.op9_rendezvous_sharding,
        "op11_best_two_fit": packing.op11_best_two_fit,
        "op12_exponion_clusters": centroids.op12_exponion_clusters,
        "op13_duckdb_resampling": resample.op13_duckdb_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_topk": topk.OP4_SQL,
        "op6_source_mixing": mixing.OP6_SQL,
        "op9_rendezvous_sharding": sharding.OP9_SQL,
        "op12_exponion_clusters": centroids.OP12_SQL,
        "op13_duckdb_resampling": resample.OP13_SQL,
    }
