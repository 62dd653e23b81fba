"""The registered queries of this subpackage and the SQL that some of them equal."""

from tripline.llm import (
    decontamination,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    search,
    spelling,
    suffix_dedup,
    tokens,
    toxicity,
    vector_codes,
    warc,
)

MODULES = (warc, suffix_dedup, search, tokens, line_dedup, quality, toxicity, decontamination, near_dedup, mixing, spelling, packing, vector_codes)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
