"""marklens: find brand marks that look or read alike, as PySpark DataFrame jobs."""

__version__ = "0.1.0"
