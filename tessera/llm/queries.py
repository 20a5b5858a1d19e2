"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, bpe, html, mixing, pii, quality, simhash, suffixes, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (toxicity.op1_toxicity, suffixes.op2_suffix_dedup, urls.op3_url_filter, simhash.op4_simhash, pii.op5_pii, html.op6_html, quality.op7_quality, bpe.op8_bpe, mixing.op9_mixing, ann.op10_ann)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urls.ORACLE_SQL, "op7_quality": quality.ORACLE_SQL}
