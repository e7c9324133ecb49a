"""auditlake: a PySpark engine for auditing source text and curating labelled audit data."""

__version__ = "0.1.0"
