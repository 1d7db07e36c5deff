"""The queries of this folder by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from paisaflow.llm import (
    alignment, collocations, decontamination, exact_dedup, line_dedup, mixing, near_dedup, ngram_join, quality,
    sharding, substring_dedup, suffix_array_dedup, toxicity,
)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_array_dedup": suffix_array_dedup.op4_suffix_array_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL,
}
