"""turnstone: conversation recall and transcript processing on PySpark."""

__version__ = "0.1.0"
