"""Queries of the thirteen operators over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op9_decontamination
from .language_id import op2_language_id
from .lexical_search import op13_lexical_search
from .license_scan import op10_license_scan
from .lm_score import op5_lm_score
from .ngram_join import op1_ngram_join
from .packing import op8_pattern_packing
from .prefix_trie import op12_prefix_trie
from .quality_rules import op6_quality_rules
from .sqltext import LEXICAL_SEARCH, NGRAM_JOIN, PREFIX_TRIE, SUBSTRING_DEDUP, URL_FILTER
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_file import op7_token_file
from .url_filter import op11_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_file": op7_token_file,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": NGRAM_JOIN,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op11_url_filter": URL_FILTER,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_lexical_search": LEXICAL_SEARCH,
}
