"""Registered queries of the corpus operators and their SQL.

Operators 1, 2, 3, 4, 7, 8, 10 and 11 have none: training, XXH64, CRC-32 and match
offsets are not in DuckDB's SQL. tests/llm holds them against brute force.
"""

from __future__ import annotations

from . import (collocations, decontam, fim, langid, line_dedup, merkle, mixing, pii, secret_scan, sharding, simhash, substring_dedup,
               toxicity)

QUERIES = {
    "op1_langid": langid.query,
    "op2_simhash": simhash.query,
    "op3_toxicity": toxicity.query,
    "op4_sharding": sharding.query,
    "op5_line_dedup": line_dedup.query,
    "op6_mixing": mixing.query,
    "op7_decontam": decontam.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_merkle": merkle.query,
    "op10_pii": pii.query,
    "op11_secrets": secret_scan.query,
    "op12_collocations": collocations.query,
    "op13_fim": fim.query,
}

ORACLE = {
    "op5_line_dedup": line_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op9_merkle": merkle.SQL,
    "op12_collocations": collocations.SQL,
    "op13_fim": fim.SQL,
}
