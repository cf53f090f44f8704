"""citeflow — literature-mining operators as Spark DataFrame jobs.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column expressions
and predicate trees), ``operators`` (DataFrame → DataFrame building blocks),
``streaming`` (incremental landing), ``plans`` (query catalogue and oracle).
"""

__version__ = "0.1.0"
