"""Time-series and trading analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""

__version__ = "0.1.0"
