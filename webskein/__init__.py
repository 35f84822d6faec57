"""Web-context analytics on Spark: cleaning, chunking, indexing, retrieval and evaluation as DataFrame operators."""

__version__ = "0.1.0"
