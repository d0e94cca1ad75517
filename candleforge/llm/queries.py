"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candleforge.llm import (
    alignment,
    bpe,
    clustering,
    decontaminate,
    html_text,
    line_dedup,
    near_dedup,
    oracles,
    packing,
    quality,
    secrets,
    substring_dedup,
    token_counts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_text": html_text.op2_html_text,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_bpe": bpe.op6_bpe,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_clustering": clustering.op11_clustering,
    "op12_packing": packing.op12_packing,
    "op13_alignment": alignment.op13_alignment,
}

#: op8's holds while a group's sketches are exact, up to quality.SKETCH_K rows.
ORACLES: dict[str, str] = {"op3_near_dedup": oracles.OP3, "op5_warc": oracles.OP5, "op8_quality": oracles.OP8}
