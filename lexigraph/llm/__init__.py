"""Training-data operators: ten Spark jobs over whole corpora, and their registered queries."""
