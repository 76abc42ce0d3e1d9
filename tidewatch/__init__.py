"""Analytics over recorded agent activity, and training-data jobs, on Spark DataFrames."""
