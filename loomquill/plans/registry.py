"""Registered queries and their SQL."""

from . import etl, lexical, more, tone

QUERIES: dict = lexical.QUERIES | tone.QUERIES | etl.QUERIES | more.QUERIES
ORACLE: dict = lexical.ORACLE | tone.ORACLE | etl.ORACLE | more.ORACLE
