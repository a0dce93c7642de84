"""All queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from mesostate.llm import bpe, decontamination, divergence, langid, licenses, parsing, passages, pii, quality, records, sharding, simhash, whitening

MODULES = (licenses, pii, quality, sharding, decontamination, simhash, records, bpe, langid, passages, whitening, divergence, parsing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
