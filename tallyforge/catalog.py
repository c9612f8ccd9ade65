"""All queries that the library registers, by name, and the SQL that each must agree with."""

from tallyforge.plans import audits  # noqa: F401  registers its queries
from tallyforge.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
