"""Registry of the imagery queries and of the SQL that each must agree with."""

from .plans import spatial, vegetation

QUERIES = vegetation.QUERIES | spatial.QUERIES
ORACLES = vegetation.ORACLES | spatial.ORACLES
