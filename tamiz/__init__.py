"""tamiz: ranked retrieval, catalogue processing and table maintenance on PySpark."""

__version__ = "0.1.0"
