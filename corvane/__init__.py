"""Corvane: document-corpus analytics and hybrid retrieval as Spark jobs."""
