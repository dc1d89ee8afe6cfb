"""Queries of the document domain, and SQL for those that SQL can express."""
