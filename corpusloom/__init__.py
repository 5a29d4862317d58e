"""corpusloom: a PySpark engine for building, auditing and scoring training corpora."""

__version__ = "0.1.0"
