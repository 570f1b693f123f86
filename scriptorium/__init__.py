"""scriptorium: a PySpark engine for structured documents, their translations and their evaluation."""

__version__ = "0.1.0"
