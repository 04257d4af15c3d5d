"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from talentloom.llm.cap_filters import OP12_SQL, op12_cap_filters
from talentloom.llm.chat_format import op9_chat_format
from talentloom.llm.decontaminate import op8_decontamination
from talentloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from talentloom.llm.filter_audit import OP13_SQL, op13_filter_audit
from talentloom.llm.near_dups import op7_near_duplicates
from talentloom.llm.packing import op1_packing
from talentloom.llm.quality import op2_quality
from talentloom.llm.repeats import op10_remove_repeats
from talentloom.llm.sort_means import OP11_SQL, op11_sort_means
from talentloom.llm.token_counts import op3_token_counts
from talentloom.llm.url_filter import op5_url_filter
from talentloom.llm.warc import OP4_SQL, op4_warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_packing, op2_quality, op3_token_counts, op4_warc_derivatives, op5_url_filter, op6_exact_dedup, op7_near_duplicates, op8_decontamination, op9_chat_format, op10_remove_repeats,
        op11_sort_means, op12_cap_filters, op13_filter_audit,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_derivatives": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op11_sort_means": OP11_SQL, "op12_cap_filters": OP12_SQL, "op13_filter_audit": OP13_SQL}
