"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, html, jaccard, licenses, media, oracles, packing, quality, sharding, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        licenses.op1_license_scan,
        decontaminate.op2_template_decontamination,
        html.op3_crf_extraction,
        quality.op4_quality,
        jaccard.op5_adaptive_prefix_join,
        sharding.op6_virtual_slots,
        packing.op7_best_fit_packing,
        urls.op8_url_filter,
        toxicity.op9_toxicity,
        media.op10_iso_media,
    ]
    return {f.__name__: f for f in functions} | {"pipeline": _pipeline}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op5_adaptive_prefix_join": oracles.OP5, "op6_virtual_slots": oracles.OP6}
