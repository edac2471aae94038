"""Registered queries over the test tables and their SQL counterparts."""

from gapgauge.catalog.oracles import ORACLES
from gapgauge.catalog.queries import QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
