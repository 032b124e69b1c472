"""Registered queries by inventory section, each with its SQL twin where SQL can express it."""

from queries.registry import ORACLES, QUERIES  # noqa: F401
from queries import sources, relational, statistics, sampling, scalars, markup, words, reports  # noqa: F401,E402
