"""millrace: program-graph analytics and data processing on Spark DataFrames."""
