"""Queries of this subpackage and the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .lm import op3_lm_score
from .media import op7_media_columns
from .mixing import op4_mix_sources
from .near import op9_ngram_join
from .quality import op5_quality_classifier
from .token_counts import OP1_SQL, op1_token_counts
from .topk import OP10_SQL, op10_top_k
from .toxicity import op2_toxicity
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_lm_score": op3_lm_score,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_media_columns": op7_media_columns,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ngram_join": op9_ngram_join,
    "op10_top_k": op10_top_k,
}

SQL = {"op1_token_counts": OP1_SQL, "op6_url_filter": OP6_SQL, "op10_top_k": OP10_SQL}
