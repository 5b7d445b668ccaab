"""Queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, gbt, katz, mixing, negatives, pii, repair, secrets, sharding, simhash, span_sql, topk, toxicity, weak
from helixframe.llm.cluster import small_batches


def _batched(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, in a session that sends Python small batches of text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_katz_backoff": _batched(katz.op1_katz_backoff),
    "op2_poisson_mix": mixing.op2_poisson_mix,
    "op3_toxic_segments": _batched(toxicity.op3_toxic_segments),
    "op4_histogram_shards": sharding.op4_histogram_shards,
    "op5_pii_spans": pii.op5_pii_spans,
    "op6_simhash_pigeonring": _batched(simhash.op6_simhash_pigeonring),
    "op7_secret_ledger": secrets.op7_secret_ledger,
    "op8_wu_manber": _batched(decontam.op8_wu_manber),
    "op9_quality_gbt": _batched(gbt.op9_quality_gbt),
    "op10_weak_quality": _batched(weak.op10_weak_quality),
    "op11_anchor_tree": negatives.op11_anchor_tree,
    "op12_coalescent_repair": _batched(repair.op12_coalescent_repair),
    "op13_segment_topk": topk.op13_segment_topk,
}
SQL = {
    "op2_poisson_mix": mixing.OP2_SQL,
    "op5_pii_spans": span_sql.op5_sql(),
    "op7_secret_ledger": span_sql.op7_sql(),
    "op8_wu_manber": span_sql.OP8_SQL,
    "op11_anchor_tree": negatives.OP11_SQL,
    "op12_coalescent_repair": repair.OP12_SQL,
    "op13_segment_topk": topk.OP13_SQL,
}
