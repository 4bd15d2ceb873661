"""Whole programs over the operators, and the queries registered from them."""

from gridloom.programs import camera, images, scalars, short  # all but scalars add to the queries of arrays
from gridloom.programs import arrays

QUERIES = scalars.QUERIES | arrays.QUERIES
ORACLE_SQL = scalars.ORACLE_SQL | arrays.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "camera", "images", "short"]
