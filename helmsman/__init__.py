"""helmsman: question routing, hybrid retrieval and operating analytics as
PySpark jobs (see README.md)."""

__version__ = "0.1.0"
