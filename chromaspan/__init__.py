"""chromaspan: genomic interval analytics as plain PySpark DataFrames."""

__version__ = "0.1.0"
