"""docloom: document ingest, retrieval and evaluation as DataFrame operations on Spark."""
