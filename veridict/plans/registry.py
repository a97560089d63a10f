"""Registry of the engine's queries and of the SQL that checks them."""

from veridict.plans import auditing, gates, scoring

QUERIES: dict = {}
ORACLES: dict = {}
for module in (scoring, auditing, gates):
    QUERIES |= module.Q
    ORACLES |= module.O
