"""All registered queries of the codec and relational layers."""

from bitquarry.plans import relational
from bitquarry.plans.queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "relational"]
