"""A PySpark engine for linked-document corpora: link graphs, titles, places, text search and answers."""
