"""Document-layout and text-region analytics as PySpark DataFrame jobs."""

__version__ = "0.1.0"
