"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from menulake.llm import decontaminate, embeddings, sharding, suffix_dedup
from menulake.llm.decontaminate import op1_benchmark_decontamination
from menulake.llm.embeddings import op10_embedding_near_dedup
from menulake.llm.html_text import op4_nearest_url_differencing
from menulake.llm.language import op5_hierarchical_language_id
from menulake.llm.packing import op6_cost_balanced_packing
from menulake.llm.sharding import op2_stratified_interleaving
from menulake.llm.simhash import op9_simhash_near_dedup
from menulake.llm.suffix_dedup import op8_suffix_array_dedup
from menulake.llm.token_files import op3_arrow_token_files
from menulake.llm.toxicity import op7_nearest_labelled_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_stratified_interleaving, op3_arrow_token_files, op4_nearest_url_differencing, op5_hierarchical_language_id, op6_cost_balanced_packing, op7_nearest_labelled_toxicity, op8_suffix_array_dedup, op9_simhash_near_dedup, op10_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """The other queries need a tokenizer, a classifier, a parser or XXH64; they are tested against brute
    force, round trips and held-out rows."""
    by = {op1_benchmark_decontamination: decontaminate, op2_stratified_interleaving: sharding, op8_suffix_array_dedup: suffix_dedup, op10_embedding_near_dedup: embeddings}
    return {f.__name__: module.ORACLE for f, module in by.items()}
