"""factlake: document facts, question routing and vector search as Spark jobs."""

__version__ = "0.1.0"
