"""All queries of the confidence analytics by name, and their SQL."""

from surety.plans import journeys, oracles, queries

QUERIES = {**queries.QUERIES, **journeys.QUERIES}
ORACLES = {**oracles.ORACLES, **journeys.ORACLES}
