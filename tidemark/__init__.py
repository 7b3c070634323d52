"""tidemark: market-microstructure analytics and training-corpus operators on Spark DataFrames."""
