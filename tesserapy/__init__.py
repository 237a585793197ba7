"""Analytics over ensembles of graph partitions, on Spark DataFrames."""
