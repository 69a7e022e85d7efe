"""Dense correlated subgraph mining and training-data operators on Spark."""
