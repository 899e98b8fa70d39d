"""The corpus operators' queries, each over its whole table, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.decontaminate import OP7_SQL, op7_decontamination
from corvane.llm.divergence import OP12_SQL, op12_divergence
from corvane.llm.exact_dedup import EXACT_INCREMENTS_SQL, OP3_SQL, exact_increments, op3_exact_dedup
from corvane.llm.language import op4_language
from corvane.llm.lm_score import op10_lm_score
from corvane.llm.mixture import OP13_SQL, op13_mixture
from corvane.llm.packing import op2_packing
from corvane.llm.preference import OP5_SQL, op5_preference
from corvane.llm.quality import op9_quality
from corvane.llm.repair import OP11_SQL, op11_repair
from corvane.llm.simhash import op6_simhash
from corvane.llm.token_counts import op1_token_counts
from corvane.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_preference": op5_preference,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_lm_score": op10_lm_score,
    "op11_repair": op11_repair,
    "op12_divergence": op12_divergence,
    "op13_mixture": op13_mixture,
    "exact_increments": exact_increments,
}
#: The others have no SQL form; tests hold them against brute force or held-out labels.
SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "exact_increments": EXACT_INCREMENTS_SQL, "op5_preference": OP5_SQL, "op7_decontamination": OP7_SQL, "op11_repair": OP11_SQL, "op12_divergence": OP12_SQL, "op13_mixture": OP13_SQL}
