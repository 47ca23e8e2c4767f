"""conefix: demand-driven program-fact analytics on PySpark."""

__version__ = "0.1.0"
