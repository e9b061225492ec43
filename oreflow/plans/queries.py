"""All registered queries of the analytics operators: name -> f(spark, sf_dir), and name -> SQL."""

from . import catalogue, heart, upkeep  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
