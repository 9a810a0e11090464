"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm.decontaminate import OP4_SQL, op4_benchmark_decontamination
from tidepool.llm.fingerprints import op12_document_fingerprints
from tidepool.llm.language_id import op9_language_id
from tidepool.llm.line_dedup import OP6_SQL, op6_line_dedup
from tidepool.llm.minhash_dedup import OP3_SQL, op3_minhash_near_dedup
from tidepool.llm.packing import op5_packing
from tidepool.llm.pii import op10_pii
from tidepool.llm.sharding import op8_sharding
from tidepool.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from tidepool.llm.substring_dedup import op1_substring_dedup
from tidepool.llm.token_alignment import op13_token_alignment
from tidepool.llm.topk import OP2_SQL, op2_exact_topk
from tidepool.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}
SQL = {"op2_exact_topk": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op11_spelling_variants": OP11_SQL}
