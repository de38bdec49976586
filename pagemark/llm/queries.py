"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .packing import op8_packing
from .pii import op5_pii
from .quality_model import op9_quality
from .quality_rules import OP3_SQL, op3_quality_rules
from .simhash import op1_simhash
from .token_files import op6_token_files
from .tool_calls import OP2_SQL, op2_tool_calls
from .topk import OP4_SQL, op4_topk
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_tool_calls": op2_tool_calls,
    "op3_quality_rules": op3_quality_rules,
    "op4_topk": op4_topk,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_topk": OP4_SQL}
