"""Memory-retrieval analytics on Spark: facts, entities, messages and queues as DataFrames."""
