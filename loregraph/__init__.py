"""Event-log analytics and weighted knowledge graphs as Spark DataFrames.

Every public operator is a function from DataFrames to DataFrames.  Nothing
in the library reads the clock or draws random ids: ``now`` and id seeds are
arguments, so a rerun of a lost task gives the same rows.
"""

__all__ = ["config", "schema", "session"]
