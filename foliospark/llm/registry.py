"""The queries of this subpackage and the DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import (
    ann, bpe, chat, convrepair, decontam, licenses, neardup, quality, sharding, spelling, tokencount, toxicity, urlfilter,
)
from foliospark.llm.common import bound_batches


def _job(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_nearest": ann.op8_nearest,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_licenses": licenses.op10_licenses,
    "op11_chat_format": chat.op11_chat_format,
    "op12_conversation_repair": convrepair.op12_conversation_repair,
    "op13_spelling_groups": spelling.op13_spelling_groups,
}
QUERIES = {name: _job(query) for name, query in QUERIES.items()}

#: Operators that SQL can express on whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": neardup.ORACLE_SQL,
    "op6_decontamination": decontam.ORACLE_SQL,
    "op9_url_filter": urlfilter.ORACLE_SQL,
    "op11_chat_format": chat.ORACLE_SQL,
    "op12_conversation_repair": convrepair.ORACLE_SQL,
    "op13_spelling_groups": spelling.ORACLE_SQL,
}
