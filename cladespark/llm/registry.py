"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladespark.llm import (
    embedding_dedup,
    exact_dedup,
    fill_middle,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    recurrent_lm,
    repeats,
    resampling,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_recurrent_lm": recurrent_lm.op3_recurrent_lm,
    "op4_repeats": repeats.op4_repeats,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_embedding_dedup": embedding_dedup.SQL,
}
