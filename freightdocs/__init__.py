"""freightdocs: shipping paperwork and free-text orders as Spark DataFrame jobs."""

__version__ = "0.1.0"
