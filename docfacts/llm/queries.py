"""Queries of this subpackage, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from docfacts.llm import decontamination, lexical_search, line_dedup, near_dedup, ngram_join
from docfacts.llm.fingerprints import op6_document_fingerprints
from docfacts.llm.packing import op5_packing
from docfacts.llm.periodic_runs import op11_periodic_runs
from docfacts.llm.quality import op1_quality_classifier
from docfacts.llm.secrets import op2_secret_scan
from docfacts.llm.suffix_tree import op9_lm_scoring
from docfacts.llm.token_counts import op4_token_counts
from docfacts.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ngram_jaccard_join": ngram_join.op12_ngram_jaccard_join,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op7_near_dedup": near_dedup.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op12_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
