"""Registries of this package's queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm.ann import op5_hash_prefix_forest
from aerolith.llm.decontamination import OP2_SQL, op2_decontamination
from aerolith.llm.fixity import OP6_SQL, op6_merkle_fixity
from aerolith.llm.language_id import op4_language_id
from aerolith.llm.lm_scoring import op7_lm_scoring
from aerolith.llm.ngram_join import OP8_SQL, op8_ngram_jaccard_join
from aerolith.llm.packing import op9_best_fit_packing
from aerolith.llm.secret_scan import op10_secret_scan
from aerolith.llm.toxicity import op3_toxicity
from aerolith.llm.url_filter import OP1_SQL, op1_url_templates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_templates": op1_url_templates,
        "op2_decontamination": op2_decontamination,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op7_lm_scoring": op7_lm_scoring,
        "op5_hash_prefix_forest": op5_hash_prefix_forest,
        "op6_merkle_fixity": op6_merkle_fixity,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_templates": OP1_SQL,
        "op2_decontamination": OP2_SQL,
        "op6_merkle_fixity": OP6_SQL,
        "op8_ngram_jaccard_join": OP8_SQL,
    }
