"""Named queries over the given tables, with an SQL statement of the same meaning.

Each module registers its queries with ``@query``; importing this package collects
them. The SQL is written independently of the Spark code and is what the results
are checked against.
"""

from tickweave.catalogue.base import QUERIES, SQL
from tickweave.catalogue import (   # noqa: F401  (registration)
    conformance, generation, quality, rules, sinks, specs, streams, transmission,
)

__all__ = ["QUERIES", "SQL"]
