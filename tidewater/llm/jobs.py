"""Registered queries of this subpackage and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import (bpe, exact_dedup, langid, license_scan, mixing, near_dup, prefix_trie, quality,
                           spelling_groups, suffix_dedup, toxicity, url_filter, warc)

_QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality": quality.op7_quality,
    "op8_langid": langid.op8_langid,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_spelling_groups": spelling_groups.op13_spelling_groups,
}
_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_license_scan": license_scan.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_spelling_groups": spelling_groups.OP13_SQL,
}

#: Runtime settings of a session that runs these queries: results are in UTC, and a batch of texts
#: that goes to a Python worker is bounded by bytes, not by rows alone.
RUNTIME = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def configured(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in RUNTIME.items():
            spark.conf.set(key, value)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    return {name: configured(fn) for name, fn in {**_QUERIES, "pipeline": corpus_pipeline.run}.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
