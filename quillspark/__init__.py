"""Document retrieval, evaluation and trace analytics on Spark DataFrames."""
