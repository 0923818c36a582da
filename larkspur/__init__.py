"""Retrieval and memory analytics over code, documents and event logs, as Spark plans."""
