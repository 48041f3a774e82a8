"""Queries and SQL of this subpackage, for the driver's entry point."""

from __future__ import annotations

from chelate.llm import ann, exact_dedup, jaccard_join, lm_scoring, merkle, mixing, periodic, pii, quality, rules, sharding, subwords, toxicity

MODULES = (sharding, subwords, quality, lm_scoring, toxicity, pii, ann, mixing, jaccard_join, exact_dedup, periodic, merkle, rules)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for m in MODULES for name, sql in m.ORACLES.items()}
