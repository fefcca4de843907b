"""Registered queries of the text and vector operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollspan.llm.audit import ORACLE as AUDIT_ORACLE
from tollspan.llm.audit import op11_filter_audit
from tollspan.llm.hmm import op10_hmm
from tollspan.llm.langid import op3_language
from tollspan.llm.licenses import op5_licenses
from tollspan.llm.lz import op1_lz_fingerprint
from tollspan.llm.neighbours import ORACLE as NEIGHBOUR_ORACLE
from tollspan.llm.neighbours import op2_rotated_codes
from tollspan.llm.packing import op8_packing
from tollspan.llm.pieces import op7_pieces
from tollspan.llm.ranked import ORACLE as RANKED_ORACLE
from tollspan.llm.ranked import op12_ranked_search
from tollspan.llm.rules import op13_rule_quality
from tollspan.llm.simhash import op6_simhash
from tollspan.llm.toxicity import op9_toxicity
from tollspan.llm.urls import ORACLE as URL_ORACLE
from tollspan.llm.urls import op4_url_cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_rotated_codes": op2_rotated_codes,
    "op3_language": op3_language,
    "op4_url_cascade": op4_url_cascade,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_hmm": op10_hmm,
    "op11_filter_audit": op11_filter_audit,
    "op12_ranked_search": op12_ranked_search,
    "op13_rule_quality": op13_rule_quality,
}
ORACLES: dict[str, str] = {
    "op2_rotated_codes": NEIGHBOUR_ORACLE,
    "op4_url_cascade": URL_ORACLE,
    "op11_filter_audit": AUDIT_ORACLE,
    "op12_ranked_search": RANKED_ORACLE,
}
