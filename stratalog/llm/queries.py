"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .bpe import op11_bpe
from .embedding_dedup import op10_embedding_dedup
from .language import op7_language
from .minhash import op6_minhash
from .mixing import op3_mixing
from .packing import op4_packing
from .secrets import op8_secrets
from .substring_dedup import op1_substring_dedup
from .token_files import op2_token_files
from .topk import ORACLE as TOPK_SQL
from .topk import op5_topk
from .toxicity import op9_toxicity
from .vector_codes import ORACLE as CODES_SQL
from .vector_codes import op12_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_bpe": op11_bpe,
    "op12_codes": op12_codes,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op5_topk": TOPK_SQL, "op12_codes": CODES_SQL}
