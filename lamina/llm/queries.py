"""All queries of this subpackage, by name, and their SQL where SQL can express them."""

from . import collocations, interactions, languages, likelihood, neighbours, oracles, packing, pieces, quality, secrets, simhash, substrings, token_counts, urls

MODULES = [urls, quality, substrings, token_counts, packing, neighbours, languages, pieces, secrets, simhash, likelihood, collocations, interactions]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()} | oracles.ORACLE_SQL
