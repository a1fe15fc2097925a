"""Position-oriented, many-sample analytics and corpus preparation on Spark DataFrames."""
