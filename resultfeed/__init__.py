"""Live SQL results on Spark: subscribe to a SELECT, receive its result and then every change of it."""

__version__ = "0.1.0"
