"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusloom.llm import html_text, jaccard, lexical, mixing, nearest, packing, ppm, quality, rules, sharding, spelling, url_filter, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_rendezvous_sharding": sharding.op2_rendezvous_sharding,
    "op3_html_text": html_text.op3_html_text,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_ppm_scores": ppm.op8_ppm_scores,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_embedding_near_duplicates": vectors.op10_embedding_near_duplicates,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_nearest_neighbours": nearest.op13_nearest_neighbours,
}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {**rules.SQL, **mixing.SQL, **url_filter.SQL, **vectors.SQL, **jaccard.SQL, **lexical.SQL, **spelling.SQL}
