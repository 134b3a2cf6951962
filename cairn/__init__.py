"""cairn: retrieval, graph and evaluation operators over Spark DataFrames."""
