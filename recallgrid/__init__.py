"""Retrieval and memory analytics on Spark: drawers, keyword and vector search, knowledge graph, rank fusion."""
