"""Queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from grovespark.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from grovespark.llm.language_id import op9_language_id
from grovespark.llm.lm_scoring import op2_lm_scoring
from grovespark.llm.mixing import op8_mixing
from grovespark.llm.ngram_join import OP4_SQL, op4_ngram_jaccard_join
from grovespark.llm.packing import op10_best_fit_packing
from grovespark.llm.quality_classifier import op1_quality_classifier
from grovespark.llm.quality_rules import op7_quality_rules
from grovespark.llm.sharding import op6_sharding
from grovespark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL}
